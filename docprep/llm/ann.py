"""Nearest neighbours by stable projections and kd-trees (operator 6).

Unit vectors are projected to a few dimensions with Gaussian directions. For a point at distance d the squared projected
distance over d squared has a chi-square law, so once everything unseen lies beyond a projected radius r, a point nearer
than the k-th best distance d is missed with probability 1 - F(r^2 / d^2). A query takes projected neighbours in order
and verifies them on the original vectors until F(r^2 / d^2) reaches `confidence`.

Two levels of kd-tree hold every row. The upper one deals the rows into cells; its splits come from a bounded sample of
projected points, and there are as many cells as the number of rows asks for. A cell's box is that of all its rows. A
cell's rows, in blocks of bounded size if there are too many, have a tree of their own. A query visits cells in waves by
increasing gap: its own cell, then the nearest few, then `GROWTH` times as many in each wave, without those that the test
rules out with the k-th best distance of the wave before, until a wave has no cell left for any query. Equal vectors are one entry that carries its k + 1 least ids: no further copy can
be among k neighbours when ties go to smaller ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, split_join

K = 5
PROJECTED = 8
CONFIDENCE = 0.99
#: Projected points (PROJECTED doubles each) that the driver reads, on average, to split the space into cells.
SAMPLE = 100_000
#: Rows to a cell on average, while the sample has four points for each cell; then cells are larger.
CELL_ROWS = 2048
#: Cells of the second wave.
NEAR_CELLS = 4
#: How many times as many cells, by increasing gap, have been looked at after each further wave.
GROWTH = 4
LEAF = 64
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
SEED = 20240817


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom, whose tail is a finite sum."""

    def tail(x: float) -> float:
        term = total = np.exp(-x / 2)
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return float(total)

    lo, hi = 0.0, 1.0
    while tail(hi) > 1 - p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - p else (lo, mid)
    return hi


def split_tree(points: np.ndarray, leaf: int, cells: int | None = None) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that halves the widest side; `cells` stops at that many leaves."""
    leaves, open_nodes = [], [np.arange(len(points))]
    while open_nodes:
        if cells is not None and len(leaves) + len(open_nodes) >= cells:
            return leaves + open_nodes
        rows = open_nodes.pop(0)
        width = np.ptp(points[rows], axis=0) if len(rows) > leaf else np.zeros(1)
        if len(rows) <= leaf or not width.max() > 0:
            leaves.append(rows)
            continue
        order = np.argpartition(points[rows, width.argmax()], len(rows) // 2)
        open_nodes += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


def directions(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, PROJECTED))


class Cells:
    """The upper tree: at each inner node a side and a value, under which a point goes left; leaves are cells."""

    def __init__(self, points: np.ndarray, cells: int):
        side, value, children, leaves = [], [], [], {}
        waiting = [(points, None)]
        while waiting:
            rows, place = waiting.pop(0)
            if place is not None:
                children[place[0]][place[1]] = len(side)
            width = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(1)
            split = len(leaves) + len(waiting) + 1 < cells and width.max() > 0
            axis = int(width.argmax()) if split else -1
            at = float(np.partition(rows[:, axis], len(rows) // 2)[len(rows) // 2]) if split else 0.0
            if split and not (rows[:, axis] < at).any():
                at = float(np.nextafter(at, np.inf))
            if split:
                low = rows[:, axis] < at
                waiting += [(rows[low], (len(side), 0)), (rows[~low], (len(side), 1))]
            else:
                leaves[len(side)] = len(leaves)
            side.append(axis)
            value.append(at)
            children.append([0, 0])
        self.side, self.value, self.children = np.array(side), np.array(value), np.array(children)
        self.cell = np.array([leaves.get(n, -1) for n in range(len(side))])

    def home(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        while (inner := self.side[node] >= 0).any():
            at = node[inner]
            node[inner] = self.children[at, (points[rows[inner], self.side[at]] >= self.value[at]).astype(np.int64)]
        return self.cell[node]


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes."""
    total = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j : j + 1]
        total += np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0) ** 2
    return total


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def cosines(vector: np.ndarray, length: float, others: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Cosines in double precision, row by row in one fixed order of addition."""
    return (others * vector).sum(axis=1) / (other_lengths * length)


def search_block(vectors: np.ndarray, ids: list[list[int]], points: np.ndarray, query: np.ndarray, query_points: np.ndarray, reach: np.ndarray, k: int, radius: float):
    """For each query (row number, ids, scores) of its nearest in one block; reach: squared distance known so far. Leaves
    are verified by increasing gap, twice as many in each step, with the test before each step."""
    leaves = split_tree(points, LEAF)
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    copies, sizes, query_sizes = np.array([len(i) for i in ids]), lengths(vectors), lengths(query)
    for q in range(len(query)):
        gap = gaps(query_points[q : q + 1], low, high)[0]
        order = gap.argsort()
        limit, rows, scores, lo, step = float(reach[q]), np.zeros(0, dtype=np.int64), np.zeros(0), 0, 1
        while lo < len(order):
            near = [leaves[leaf] for leaf in order[lo : lo + step] if gap[leaf] <= radius * limit]
            if not near:
                break
            near = np.concatenate(near)
            rows = np.concatenate([rows, near])
            scores = np.concatenate([scores, cosines(query[q], query_sizes[q], vectors[near], sizes[near])])
            best = np.argsort(-scores, kind="stable")
            enough = int(np.searchsorted(np.cumsum(copies[rows[best]]), k + 1)) + 1
            keep = scores >= scores[best[min(enough, len(best)) - 1]]  # ties stay for the order of ids
            rows, scores = rows[keep], scores[keep]
            if copies[rows].sum() > k:
                limit = min(limit, max(0.0, 2 - 2 * float(scores.min())))
            lo, step = lo + step, 2 * step
        if len(rows):
            yield q, np.concatenate([ids[r] for r in rows]), np.repeat(scores, copies[rows])


def _dense(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _searched(pairs: DataFrame, blocks: DataFrame, k: int, radius: float) -> DataFrame:
    """`query_class`, `vec_id`, `score`: the best of each block for each query that visits its cell."""
    n_groups = pairs.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups"))
    grouped = pairs.join(n_groups, "cell").withColumn("q", F.pmod(F.xxhash64("query_class"), F.col("groups")).cast("int"))
    spread = blocks.join(n_groups, "cell").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    visits = grouped.join(blocks.select("cell", "block").distinct(), "cell")

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_class": [], "vec_id": [], "score": []}
        if len(q) and len(b):
            found = search_block(_dense(b.vector), [list(i) for i in b.ids], _dense(b.point), _dense(q.vector), _dense(q.point), q.reach.to_numpy(), k, radius)
            for row, ids, scores in found:
                order = np.lexsort((ids, -scores))[: k + 1]
                out["query_class"] += [q.query_class.iloc[row]] * len(order)
                out["vec_id"] += ids[order].tolist()
                out["score"] += scores[order].tolist()
        return pd.DataFrame(out)

    key = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("cell", "block", "q")]
    left = visits.select(*key("l"), "query_class", "vector", "point", "reach")
    right = spread.select(*key("r"), "vector", "ids", "point")
    return left.groupBy("l_cell", "l_block", "l_q").cogroup(right.groupBy("r_cell", "r_block", "r_q")).applyInPandas(run, "query_class long, vec_id long, score double")


def _best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)


def nearest(vectors: DataFrame, is_query: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, cells: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` (cosine): the k nearest found of each row for which SQL `is_query` holds.

    `is_query` is over the column `vec_id`. Vectors that are null, empty, zero, or hold a null or non-finite component
    take no part, nor do vectors of another length than the most frequent one (of two, the greater). Null ids take no
    part. Rows of one id and vector count once. Ties go to smaller ids. With fewer than k candidates all are returned.
    Without `cells` the number of rows sets how many there are. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0)).where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == sizes["n"])
    along = directions(sizes["n"])
    radius = chi2_quantile(confidence, PROJECTED)
    share = 1 << 30
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(share)) < max(1, share * sample // sizes["count"]))

    def project(parts):
        for part in parts:
            if len(part):
                yield pd.DataFrame({"point": list(unit_rows(_dense(part.vector)) @ along)})

    picked = chosen.select("vector").mapInPandas(project, "point array<double>").limit(2 * sample).collect()
    fitted = np.unique(np.array([r["point"] for r in picked]).reshape(-1, PROJECTED), axis=0)
    tree = Cells(fitted, cells or max(1, min(-(-sizes["count"] // CELL_ROWS), len(fitted) // 4)))

    few = Window.partitionBy("vector").orderBy("vec_id")
    least = rows.distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    classes = least.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def place(parts):
        for part in parts:
            if len(part):
                points = unit_rows(_dense(part.vector)) @ along
                yield part.assign(query_class=[int(i[0]) for i in part.ids], point=list(points), cell=tree.home(points).astype(np.int32))

    placed = durable(classes.mapInPandas(place, "vector array<double>, ids array<long>, query_class long, point array<double>, cell int"))
    sides = [F.array(*[f(F.col("point")[j]) for j in range(PROJECTED)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"), *sides).orderBy("cell").collect()
    low, high = (np.array([b[name] for b in boxes], dtype=np.float64).reshape(-1, PROJECTED) for name in ("low", "high"))
    names = np.array([b["cell"] for b in boxes], dtype=np.int32)
    n_blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    blocks = split_join(placed, n_blocks, ["cell"]).select("cell", F.pmod(F.xxhash64("query_class"), F.col("n")).cast("int").alias("block"), "vector", "ids", "point")

    asked = rows.where(is_query).distinct().join(placed.select(F.col("vector").alias("v"), "query_class", "point", "cell"), F.col("vector") == F.col("v"))
    members = durable(asked.select(F.col("vec_id").alias("query_id"), "query_class", "vector", "point", "cell"))
    queries = members.groupBy("query_class").agg(F.first("vector").alias("vector"), F.first("point").alias("point"), F.first("cell").alias("home"))

    def visits(known: DataFrame, first: int, last: int) -> DataFrame:
        """A row for each query and cell of the ranks first to last by gap, its own cell apart, that is not ruled out."""
        found = known.groupBy("query_class").agg(F.when(F.count("*") > k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).otherwise(4.0).alias("reach"))
        wide = queries.join(found, "query_class", "left").select("query_class", "point", "home", F.coalesce("reach", F.lit(4.0)).alias("reach"))

        def visit(parts):
            step = max(1, (1 << 16) // max(1, len(names)))
            for part in (p.iloc[lo : lo + step] for p in parts for lo in range(0, len(p), step)):
                gap = gaps(_dense(part.point), low, high)
                gap[part.home.to_numpy()[:, None] == names] = np.inf
                order = np.argsort(gap, axis=1, kind="stable")[:, first:last]
                row, rank = np.nonzero(np.take_along_axis(gap, order, axis=1) <= radius * part.reach.to_numpy()[:, None])
                yield part[["query_class", "reach"]].iloc[row].assign(cell=names[order[row, rank]])

        return wide.mapInPandas(visit, "query_class long, reach double, cell int")

    own_cell = queries.withColumn("cell", F.col("home")).withColumn("reach", F.lit(4.0))
    every = durable(_best(_searched(own_cell, blocks, k, radius), k + 1).drop("r"))
    first, last = 0, NEAR_CELLS
    while len(names) > first + 1:
        wave = durable(visits(every, first, last))
        if wave.isEmpty():  # gaps only grow from wave to wave
            break
        asking = wave.join(queries.drop("home"), "query_class")
        every = durable(_best(every.unionByName(_searched(asking, blocks, k, radius)), k + 1).drop("r"))
        first, last = last, GROWTH * last
    packed = every.groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    own = split_join(members, packed, ["query_class"]).select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    ranked = own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
