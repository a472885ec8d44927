"""Aggregates over point DataFrames and query logs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapoint.functions import keys
from terrapoint.types import BBox, axes

#: Gamma(1 + 1/D) for D = 1 .. 8. Fixed values.
GAMMA = (1.0, 0.886226925452758, 0.8929795115692493, 0.906402477055477, 0.9181687423997607, 0.927760442095343, 0.9354892840699859, 0.9417426998497052)


def extent(df: DataFrame, dims: int) -> DataFrame:
    """One row: n, lo0.., hi0.. (null when empty)."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo{d}") for d, a in enumerate(axes(dims))], *[F.max(a).alias(f"hi{d}") for d, a in enumerate(axes(dims))])


def extent_box(df: DataFrame, dims: int) -> tuple[int, BBox | None]:
    r = extent(df, dims).first()
    return r["n"], BBox([r[f"lo{d}"] for d in range(dims)], [r[f"hi{d}"] for d in range(dims)]) if r["n"] else None


def moments(df: DataFrame, dims: int) -> DataFrame:
    """One row an axis: mean, population variance and population skewness (0 on an axis that doesn't vary)."""
    rows = df.agg(*[f(a).alias(f"{name}{d}") for d, a in enumerate(axes(dims)) for name, f in (("mean", F.avg), ("var", F.var_pop), ("skew", F.skewness))])
    parts = [F.struct(F.lit(d).alias("axis"), F.col(f"mean{d}").alias("mean"), F.col(f"var{d}").alias("variance"), F.when(F.sqrt(F.col(f"var{d}")) > 1e-12, F.coalesce(F.col(f"skew{d}"), F.lit(0.0))).otherwise(0.0).alias("skewness")) for d in range(dims)]
    return rows.select(F.inline(F.array(*parts)))


def reservoir(df: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Uniform sample without replacement, the same for the same ids and seed: the smallest rows by a hash of the id,
    in the order of that hash."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(size)


def replayed_reservoir(rows: list, size: int) -> list:
    """The sample that a one-pass reservoir with the library's fixed generator keeps; for short, ordered inputs."""
    state, kept = 0x517CC1B727220A95, []  # fixed value: the generator's seed
    for count, row in enumerate(rows, 1):
        if len(kept) < size:
            kept.append(row)
            continue
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64  # fixed values: the generator's step
        if (j := (state >> 11) % count) < size:
            kept[j] = row
    return kept


def sampled_points(df: DataFrame, dims: int, most: int = 4096) -> np.ndarray:
    """Coordinates of the reservoir of the whole table; `most` rows come to the driver at most."""
    rows = reservoir(df.select("id", *axes(dims)), most).toPandas()
    return rows[axes(dims)].to_numpy(dtype=np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        diff = a[:, d][:, None] - b[:, d][None, :]
        total += diff * diff
    return np.sqrt(total)


def clustering_coefficient(points: np.ndarray) -> float:
    """Nearest-neighbour distance expected of a uniform sample, over the one observed; over 1 means clusters."""
    n, dims = points.shape
    if n < 2:
        return 1.0
    spans = np.maximum(points.max(axis=0) - points.min(axis=0), 1e-12)
    expected = (np.prod(spans) / n) ** (1 / dims) * GAMMA[dims - 1]
    asked = min(n, 256)
    chosen = np.arange(0, n, max(1, n // asked))[:asked]
    near = _distances(points[chosen], points)
    near[np.arange(len(chosen)), chosen] = np.inf
    observed = near.min(axis=1).mean()
    return 1.0 if observed < 1e-15 else max(float(expected / observed), 0.0)


def effective_dimension(points: np.ndarray) -> float:
    """Correlation dimension between the 10th and 50th percentile of pairwise distances, within 0.5 .. D + 0.5."""
    n, dims = points.shape
    asked = min(n, 200)
    chosen = points[np.arange(0, n, max(1, n // max(asked, 1)))[:asked]]
    m = len(chosen)
    if m < 4:
        return float(dims)
    dist = np.sort(_distances(chosen, chosen)[np.triu_indices(m, 1)])
    dist = dist[dist > 1e-15]
    if len(dist) < 4:
        return float(dims)
    r1, r2 = dist[int(len(dist) * 0.10)], dist[int(len(dist) * 0.50)]
    if r2 / r1 < 1.01:
        return float(dims)
    c1, c2 = np.searchsorted(dist, [r1, r2], side="right")
    if c1 >= c2:
        return float(dims)
    return float(min(max((math.log(c2) - math.log(c1)) / (math.log(r2) - math.log(r1)), 0.5), dims + 0.5))


def query_mix(log: DataFrame) -> DataFrame:
    """One row: shares of range, knn and join queries and the mean selectivity; (1, 0, 0, 0.01) without queries.
    log: kind, selectivity, hit."""
    n = F.count(F.lit(1))
    share = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)) / n
    out = log.agg(n.alias("n"), share("range").alias("range"), share("knn").alias("knn"), share("join").alias("join"), F.avg("selectivity").alias("sel"))
    pick = lambda c, empty: F.when(F.col("n") > 0, F.col(c)).otherwise(F.lit(empty))
    return out.select(pick("range", 1.0).alias("range_fraction"), pick("knn", 0.0).alias("knn_fraction"), pick("join", 0.0).alias("join_fraction"), pick("sel", 0.01).alias("mean_selectivity"))


def hit_rates(log: DataFrame) -> DataFrame:
    """One row: share of hits by kind, 0 for kinds without queries."""
    rate = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("hit").cast("double"))), F.lit(0.0)).alias(f"{kind}_hit_rate")
    return log.agg(rate("range"), rate("knn"), rate("join"))


def latency(log: DataFrame) -> DataFrame:
    """One row: queries, their whole mean and last latency (ns, 0 without queries). log: ts, latency_ns."""
    n = F.count(F.lit(1))
    return log.agg(n.alias("queries"), F.coalesce(F.floor(F.sum("latency_ns") / n), F.lit(0)).cast("long").alias("mean_ns"), F.coalesce(F.max_by("latency_ns", "ts"), F.lit(0)).cast("long").alias("last_ns"))


def nearest_rank(df: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """percent and value: the value at place min(int(n * p / 100), n - 1) of the sorted column. Places are found from
    counts of distinct values over ordered ranges, so no task sorts everything."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    ranged = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    from terrapoint.staging import staged

    ranged = staged(ranged, "percentiles")
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("c").alias("n")).collect())
    n, before, offsets = sum(s for _, s in sizes), 0, {}
    for p, s in sizes:
        offsets[p] = before
        before += s
    if not n:
        return df.sparkSession.createDataFrame([], "percent double, value double")
    mapping = F.create_map(*[F.lit(v) for p, o in offsets.items() for v in (p, o)])
    upto = F.element_at(mapping, F.col("part")) + F.sum("c").over(Window.partitionBy("part").orderBy("value"))
    placed = ranged.withColumn("upto", upto)
    wanted = [(float(p), min(int(n * p / 100), n - 1)) for p in percents]
    picks = [F.struct(F.lit(p).alias("percent"), F.lit(k).alias("k")) for p, k in wanted]
    return placed.select("value", "c", "upto", F.inline(F.array(*picks))).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c"))).select("percent", F.col("value").cast("double").alias("value"))


def occupancy(df: DataFrame, sizes: list[float], origins: list[float]) -> DataFrame:
    """cell0.. and n: points of each occupied cell."""
    cells = [keys.grid_cell(F.col(a), s, o).alias(f"cell{d}") for d, (a, s, o) in enumerate(zip(axes(len(sizes)), sizes, origins, strict=True))]
    return df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, box: BBox, columns: int = 60, rows: int = 20) -> DataFrame:
    """cx, cy, n of a raster over the box, cells closed on both sides: a point on a shared edge counts in both."""
    w, h = (box.hi[0] - box.lo[0]) / columns, (box.hi[1] - box.lo[1]) / rows

    def closed(x: Column, lo: float, step: float, count: int) -> Column:
        if step <= 0:
            return F.sequence(F.lit(0), F.lit(count - 1))
        guess = F.least(F.greatest(F.floor((x - lo) / step).cast("int"), F.lit(0)), F.lit(count - 1))
        near = F.sequence(F.greatest(guess - 1, F.lit(0)), F.least(guess + 1, F.lit(count - 1)))
        return F.filter(near, lambda i: (x >= F.lit(lo) + i * F.lit(step)) & (x <= F.lit(lo) + (i + 1) * F.lit(step)))

    placed = df.select(F.explode(closed(F.col("x0"), box.lo[0], w, columns)).alias("cx"), "x1").select("cx", F.explode(closed(F.col("x1"), box.lo[1], h, rows)).alias("cy"))
    return placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def raster(df: DataFrame, box: BBox, columns: int = 60, rows: int = 20) -> str:
    """The density as text, the top row first."""
    glyphs = " ·:+*#"
    counts = {(r["cx"], r["cy"]): r["n"] for r in density(df, box, columns, rows).collect()}  # columns * rows at most
    top = max(counts.values(), default=0) or 1
    return "\n".join("".join(glyphs[int(counts.get((x, y), 0) / top * 5)] for x in range(columns)) for y in reversed(range(rows)))
