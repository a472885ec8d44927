"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample (`sample` rows, the smallest by a hash of their id) and every row is indexed.
A query walks all trees through one priority queue, ordered by the smallest margin to a split on the way, and opens
leaves until they hold a given share of the sample; the share is the smallest that reaches `recall` against brute force
on the sample. It also goes on until the leaves of one tree hold more than k rows, of all rows, so that no query comes
back short. Trees are as deep as leaves of about `leaf_rows` rows need (four leaves at least), within what the sample can place. The rows of the opened leaves are then ranked exactly, in double precision.

Inner products become angles by one added axis, sqrt(M^2 - |x|^2) with M the largest norm, which is 0 for queries.
Equal vectors are indexed once, with the few smallest ids they can contribute to any answer, so a vector that a third
of all rows share costs no more than another. Rows meet queries by branch: the largest part of a tree that holds
`BLOCK_BYTES` of vectors at most, by a count of all rows; larger leaves, and branches that more than `BLOCK_QUERIES`
queries open, are cut into blocks. Each block scores the opened leaves alone and hands on the best few of each query, so
a query has as many short lists as it meets branches, however many leaves it opens in them. The share of rows that must be looked at for a given recall belongs to
the data: for vectors without structure it is large and stays so at every size. A row is scored in each tree that finds
it, so at a share s a query costs s times the number of trees dot products a row, which for such vectors is more than
brute force needs; clustered vectors need a small part of that.

Edge cases: vectors that are null, zero, hold null or non-finite components, or differ in length from most take no
part, neither as queries nor as candidates, and rows with a null id neither; ties go to the smaller id; fewer
candidates than k give fewer rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapoint.llm.common import staged

RESULT = "query_id long, rank int, vec_id long, score double"
BLOCK_BYTES, BLOCK_QUERIES = 32 << 20, 4_096
#: Scores held at once inside a block, and candidates gathered before they are cut to the best few of each query.
SCORES, GATHERED = 1 << 22, 1 << 20


class Forest:
    """`trees` binary trees of equal depth; node i has the children 2i + 1 and 2i + 2. Splits at the sample's median."""

    def __init__(self, points: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        inner = (1 << depth) - 1
        self.normals = rng.standard_normal((trees, inner, points.shape[1]))
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            at = np.zeros(len(points), dtype=np.int64)
            for _ in range(depth):
                side = np.zeros(len(points), dtype=np.int64)
                for node in np.unique(at):
                    here = at == node
                    along = points[here] @ self.normals[t, node]
                    self.cuts[t, node] = np.median(along)
                    side[here] = along > self.cuts[t, node]
                at = 2 * at + 1 + side
        self.sizes = np.stack([np.bincount(c, minlength=1 << depth) for c in self.leaves(points).T])

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf number (0 to 2^depth - 1) of each point in each tree."""
        out = np.empty((len(points), self.trees), dtype=np.int64)
        first = (1 << self.depth) - 1
        for t in range(self.trees):
            margins = points @ self.normals[t].T - self.cuts[t]
            at = np.zeros(len(points), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (margins[np.arange(len(points)), at] > 0)
            out[:, t] = at - first
        return out

    def visits(self, point: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, the most promising first."""
        margins = self.normals @ point - self.cuts
        first = (1 << self.depth) - 1
        queue = [(-np.inf, t, 0) for t in range(self.trees)]
        while queue:
            worst, t, node = heapq.heappop(queue)
            while node < first:
                m = margins[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(worst, abs(m)), t, far))
                node = near
            yield t, node - first

    def opened(self, point: np.ndarray, share: float, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Cells (tree * 2^depth + leaf) to open until they hold `share` of the sample, counted tree by tree, and those
        of one tree hold `least` rows. rows: all rows by tree and leaf."""
        wanted, got, cells, held = share * self.sizes.sum(), 0, [], np.zeros(self.trees, dtype=np.int64)
        for t, leaf in self.visits(point):
            cells.append((t << self.depth) + leaf)
            got += self.sizes[t, leaf]
            if rows is not None:
                held[t] += rows[t, leaf]
            if got >= wanted and (rows is None or held.max() >= least):
                break
        return cells


def calibrated(forest: Forest, points: np.ndarray, raw: np.ndarray, k: int, recall: float, tests: int = 200) -> float:
    """The smallest share, in steps of a fortieth, that reaches `recall` for `tests` rows of the sample. The sample's
    own neighbours lie farther apart than those among all rows, so the figure errs on the safe side."""
    leaves = forest.leaves(points)
    tests, scores = min(tests, len(raw)), raw[: min(tests, len(raw))] @ raw.T
    scores[np.arange(tests), np.arange(tests)] = -np.inf
    k = min(k, len(raw) - 1)
    if k < 1:
        return 1.0
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    queries = np.hstack([raw[:tests], np.zeros((tests, points.shape[1] - raw.shape[1]))])
    needed = np.ones((tests, k))
    total = forest.sizes.sum()
    for i in range(tests):
        got, mine = 0, leaves[top[i]]
        for t, leaf in forest.visits(queries[i]):
            got += forest.sizes[t, leaf]
            found = mine[:, t] == leaf
            needed[i, found] = np.minimum(needed[i, found], got / total)
    share = float(np.quantile(needed, recall))
    return min(1.0, np.ceil(share * 40) / 40)


def branches(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The branch of each tree and leaf, and of each branch how many blocks of `most` rows it takes: the highest nodes
    that hold `most` rows at most, and single leaves beyond that. sizes: all rows by tree and leaf."""
    of, blocks = np.zeros(sizes.shape, dtype=np.int64), []
    for t in range(len(sizes)):
        queue = [(0, sizes.shape[1])]
        while queue:
            lo, hi = queue.pop()
            held = int(sizes[t, lo:hi].sum())
            if held <= most or hi - lo == 1:
                of[t, lo:hi] = len(blocks)
                blocks.append(max(1, -(-held // most)))
            else:
                queue += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
    return of, np.array(blocks)


def _best(q: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each q with the largest scores, ties to the smaller c."""
    order = np.lexsort((c, -score, q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    order = order[place < k]
    return q[place < k], c[order], score[order]


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """a[i] * b[j], row by row, in pieces that bound the memory."""
    step = max(1, SCORES // a.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", a[i[at : at + step]], b[j[at : at + step]], optimize=False) for at in range(0, len(i), step)])


def _finite(column: Column) -> Column:
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return column.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(column, lambda x: x != 0)


def search(
    rows: DataFrame,
    query_rows: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    trees: int = 6,
    leaf_rows: int = 1024,
    sample: int = 16_384,
    recall: float = 0.95,
    seed: int = 17,
) -> DataFrame:
    """The k nearest found for each row for which `query_rows` (a condition on `id`) holds: query_id, rank, vec_id,
    score. See the module for the method and the edge cases."""
    spark = rows.sparkSession
    given = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    given = given.where(F.col("id").isNotNull() & _finite(F.col("v")))
    lengths = given.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1)
    first = lengths.first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    valid = given.where(F.size("v") == int(first["n"]))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    largest = float(valid.agg(F.max(norm2)).first()[0])
    chosen = valid.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    raw = np.stack(chosen["v"].to_numpy()).astype(np.float64)

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(0.0, largest - (v * v).sum(axis=1)))[:, None]])

    points = lifted(raw)
    n = valid.count()
    depth = max(0, min(int(np.log2(max(1, n / leaf_rows, min(4, n / 64)))), int(np.log2(max(1, len(raw) / 16)))))
    forest = Forest(points, trees if depth else 1, depth, seed)
    share = calibrated(forest, points, raw, k, recall) if depth else 1.0
    width = first["n"]
    held = spark.sparkContext.broadcast(forest)  # bounded: trees * 2^depth normals

    # Equal vectors form one class, named by its smallest id, with the k + 1 smallest ids.
    by_vector = Window.partitionBy("v").orderBy("id")
    members = valid.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members"))
    classes = staged(members.select(F.col("members")[0].alias("cls"), "v", "members"), "ann-classes")

    @F.pandas_udf("array<int>")
    def cells_of(v: pd.Series) -> pd.Series:
        f = held.value
        return pd.Series([[*row] for row in f.leaves(lifted(np.stack(v.to_numpy()))) + (np.arange(f.trees) << f.depth)]) if len(v) else pd.Series([], dtype=object)

    @F.pandas_udf("array<array<int>>")
    def opened_by(v: pd.Series) -> pd.Series:
        """By branch: its number, and the cells to open in it."""
        f, (rows, of) = held.value, counted.value
        out = []
        for x in v:
            met: dict[int, list[int]] = {}
            for cell in f.opened(np.append(x, 0.0), share, rows, min(k + 1, int(rows[0].sum()))):
                branch = int(of[cell >> f.depth, cell & ((1 << f.depth) - 1)])
                met.setdefault(branch, [branch]).append(cell)
            out.append(list(met.values()))
        return pd.Series(out, dtype=object)

    indexed = classes.select("cls", "v", F.explode(cells_of("v")).alias("cell"))
    sizes = np.zeros((forest.trees, 1 << depth), dtype=np.int64)
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # trees * 2^depth rows at most
        sizes[r["cell"] >> depth, r["cell"] & ((1 << depth) - 1)] = r["n"]
    branch_of, parts = branches(sizes, max(1, BLOCK_BYTES // (8 * width)))
    counted = spark.sparkContext.broadcast((sizes, branch_of))
    queries = valid.where(query_rows).select(F.col("id").alias("query_id"), "v").join(classes.select("v", "cls"), "v").select("query_id", F.col("cls").alias("q"))
    asked = queries.select("q").distinct().join(classes.select(F.col("cls").alias("q"), "v"), "q")
    asked = asked.select("q", "v", F.explode(opened_by("v")).alias("met")).select("q", "v", F.col("met")[0].alias("branch"), F.slice("met", 2, 1 << depth).alias("cells"))
    asked = staged(asked, "ann-queries")

    # Blocks: a branch's rows meet its queries in pieces of bounded size, however large either side grows.
    query_parts = np.ones(len(parts), dtype=np.int64)
    for r in asked.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).collect():  # trees * 2^depth rows at most
        query_parts[r["branch"]] = -(-r["n"] // BLOCK_QUERIES)
    layout = [((t << depth) + leaf, int(branch), int(parts[branch]), int(query_parts[branch])) for (t, leaf), branch in np.ndenumerate(branch_of)]
    cells = spark.createDataFrame(layout, "cell int, branch int, parts long, query_parts long")
    whole = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    left = indexed.join(F.broadcast(cells), "cell")
    left = left.select("branch", "cell", "cls", "v", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("b"), F.explode(whole(F.col("query_parts"))).alias("qb"))
    right = asked.join(F.broadcast(cells.drop("cell").distinct()), "branch")
    right = right.select("branch", "q", "v", "cells", F.explode(whole(F.col("parts"))).alias("b"), F.pmod(F.xxhash64("q"), F.col("query_parts")).alias("qb"))

    def best(points_in: pd.DataFrame, queries_in: pd.DataFrame) -> pd.DataFrame:
        if points_in.empty or queries_in.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        order = np.lexsort((points_in["cls"].to_numpy(), points_in["cell"].to_numpy()))
        p, c, cell = np.stack(points_in["v"].to_numpy())[order], points_in["cls"].to_numpy()[order], points_in["cell"].to_numpy()[order]
        qs, names, lists = np.stack(queries_in["v"].to_numpy()), queries_in["q"].to_numpy(), queries_in["cells"].to_numpy()
        opened, by = np.concatenate(lists), np.repeat(np.arange(len(qs)), [len(x) for x in lists])
        by = by[np.argsort(opened, kind="stable")]
        opened = np.sort(opened, kind="stable")
        gathered, held_now, kept = [], 0, 0
        for leaf in np.unique(cell):
            lo, hi = np.searchsorted(cell, [leaf, leaf + 1])
            askers = by[slice(*np.searchsorted(opened, [leaf, leaf + 1]))]
            step = max(1, SCORES // (hi - lo))
            for at in range(0, len(askers), step):
                part = askers[at : at + step]
                near = qs[part] @ p[lo:hi].T
                m = min(hi - lo, k + 1)
                if m < hi - lo:  # ties at the edge, and last-digit differences, stay in
                    edge = np.partition(near, hi - lo - m, axis=1)[:, hi - lo - m] - 1e-9 * max(largest, 1e-300)
                    i, j = np.nonzero(near >= edge[:, None])
                else:
                    i, j = (x.ravel() for x in np.indices(near.shape))
                gathered.append(_best(part[i], c[lo + j], _dots(qs, part[i], p, lo + j), k + 1))
                held_now += len(gathered[-1][0])
                if held_now > kept + GATHERED:
                    gathered = [_best(*map(np.concatenate, zip(*gathered, strict=True)), k + 1)]
                    held_now = kept = len(gathered[0][0])
        if not gathered:
            return best(points_in[:0], queries_in)
        q, found, score = _best(*map(np.concatenate, zip(*gathered, strict=True)), k + 1)
        return pd.DataFrame({"q": names[q], "cls": found, "score": score})

    near = left.groupBy("branch", "b", "qb").cogroup(right.groupBy("branch", "b", "qb")).applyInPandas(best, "q long, cls long, score double")
    ranked = near.withColumn("r", F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))).where(F.col("r") <= k + 1).select("q", "cls", "score").distinct()
    answers = queries.join(ranked, "q").join(classes.select("cls", "members"), "cls")
    answers = answers.select("query_id", "score", F.explode("members").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
