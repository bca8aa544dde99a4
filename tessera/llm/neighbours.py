"""Approximate nearest neighbours: stable projections to few dimensions, kd-trees over them, a chi-square stopping test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

DIMENSIONS = 8
FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def chi_square_share(x: np.ndarray) -> np.ndarray:
    """Distribution function of chi-square with DIMENSIONS (an even number of) degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, DIMENSIONS // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_point(share: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(np.array(middle)) < share else (low, middle)
    return high


class KdTree:
    """Leaves of at most `leaf` points, halved along the widest side, with the box around each."""

    def __init__(self, points: np.ndarray, leaf: int = 32) -> None:
        self.order = np.arange(len(points))
        bounds, stack = [], [(0, len(points))]
        while stack:
            low, high = stack.pop()
            if high - low <= leaf:
                bounds.append((low, high))
                continue
            own = points[self.order[low:high]]
            side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(own[:, side], middle)]
            stack += [(low, low + middle), (low + middle, high)]
        self.bounds = np.array(bounds, dtype=np.int64).reshape(-1, 2)
        boxes = [points[self.order[a:b]] for a, b in bounds]
        self.low = np.stack([b.min(axis=0) for b in boxes])
        self.high = np.stack([b.max(axis=0) for b in boxes])
        self.points = points

    def leaves_by_distance(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves from the nearest on, and the squares of their boxes' distances from q."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        distance = (gap * gap).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        return order, distance[order]


class CellTree:
    """The top of a kd-tree, fitted on sampled points: every point of space falls into one of its cells."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        side, value, below, cell, self.cells = [-1], [0.0], [0], [0], 0
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            own = points[rows]
            widest = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(rows) else 0
            values = own[:, widest]
            if len(rows) <= leaf or values.min() == values.max():
                cell[node] = self.cells
                self.cells += 1
                continue
            cut = np.median(values)
            cut = cut if cut > values.min() else values[values > cut].min()
            side[node], value[node], below[node] = widest, cut, len(side)
            for part in (rows[values < cut], rows[values >= cut]):
                stack.append((len(side), part))
                side.append(-1)
                value.append(0.0)
                below.append(0)
                cell.append(0)
        self.side, self.value, self.below, self.cell = np.array(side), np.array(value), np.array(below), np.array(cell)

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        while len(at := np.flatnonzero(self.side[node] >= 0)):
            here = node[at]
            node[at] = self.below[here] + (points[at, self.side[here]] >= self.value[here])
        return self.cell[node]


def projection(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, DIMENSIONS))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times powers of two, which lose nothing, such that no square is out of range, and their norms."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors, np.sqrt((vectors * vectors).sum(axis=1))


def rows_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def projected(column: pa.Array, dim: int, seed: int) -> np.ndarray:
    """Projections of the unit vectors."""
    vectors, norms = scaled(rows_of(column, dim))
    return vectors / norms[:, None] @ projection(dim, seed)


def place(trees: dict[int, CellTree], seed: int):
    """For mapInArrow: (id, vector) to the same with length, cell and projected point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                points = projected(own.column(1), dim, seed)
                cells = trees[dim].cell_of(points) if dim in trees else np.zeros(len(points), dtype=np.int64)
                at = pa.array(np.arange(0, points.size + 1, DIMENSIONS, dtype=np.int32))
                columns = [pa.array(np.full(len(points), dim, dtype=np.int32)), pa.array(cells), pa.ListArray.from_arrays(at, pa.array(points.reshape(-1)))]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=["vec_id", "vector", "dim", "cell", "point"])

    return run


def open_cells(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], limit: float):
    """For mapInArrow: queries with the cell they were searched in and the score they have to beat, to the other cells that
    the chi-square test leaves open for them. Without a score to beat every cell is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            dims, own, bounds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "bound"))
            points = rows_of(batch.column("point"), DIMENSIONS)
            for i, (dim, cell, bound, q) in enumerate(zip(dims, own, bounds, points, strict=True)):
                numbers, low, high = boxes[dim]
                gap = np.maximum(np.maximum(low - q, q - high), 0)
                far = (gap * gap).sum(axis=1)
                reach = np.inf if np.isnan(bound) else limit * max(0.0, 2 - 2 * bound)
                to = numbers[(far <= reach) & (numbers != cell)]
                rows.append(np.full(len(to), i))
                cells.append(to)
            none = np.empty(0, dtype=np.int64)
            out = batch.select(["row", "vec_id", "vector", "dim", "bound"]).take(pa.array(np.concatenate([*rows, none])))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate([*cells, none]))], names=["row", "vec_id", "vector", "dim", "bound", "cell"])

    return run


def cosines(vectors: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """The same sums for equal rows, wherever they stand."""
    return (vectors * q).sum(axis=1) / (norms * q_norm)


class Block:
    """Rows of a cell with the kd-tree over their projections."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, matrix: np.ndarray) -> None:
        self.rows, self.ids = rows, ids
        self.vectors, self.norms = scaled(vectors)
        self.matrix = matrix
        self.tree = KdTree(self.vectors / self.norms[:, None] @ matrix)

    def nearest(self, row: int, q: np.ndarray, count: int, limit: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the `count` nearest rows found for q other than `row`, best first.

        Projected neighbours come in the order of their distance: those nearer than the next leaf's box are due. They are
        verified on the vectors, until the projected distance reached is so far beyond the count-th best, here or in the
        cells before (bound), that a better row would lie outside with no more than the chance behind limit.
        """
        (q,), (q_norm,) = scaled(q[None, :])
        point = q / q_norm @ self.matrix
        tree = self.tree
        leaves, far = tree.leaves_by_distance(point)
        best_at, best = np.empty(0, dtype=np.int64), np.empty(0)
        waiting, waiting_far = np.empty(0, dtype=np.int64), np.empty(0)
        at, step = 0, 4
        while at < len(leaves) or len(waiting):
            opened = leaves[at : at + step]
            at, step = at + step, step * 2
            new = np.concatenate([*(tree.order[a:b] for a, b in tree.bounds[opened]), np.empty(0, dtype=np.int64)])
            offset = tree.points[new] - point
            waiting, waiting_far = np.concatenate([waiting, new]), np.concatenate([waiting_far, (offset * offset).sum(axis=1)])
            reach = far[at] if at < len(leaves) else np.inf
            due = waiting_far <= reach
            found, waiting, waiting_far = waiting[due], waiting[~due], waiting_far[~due]
            found = found[self.rows[found] != row]
            if len(found):
                best_at = np.concatenate([best_at, found])
                best = np.concatenate([best, cosines(self.vectors[found], self.norms[found], q, q_norm)])
                order = np.lexsort((self.rows[best_at], self.ids[best_at], -best))[:count]
                best_at, best = best_at[order], best[order]
            beat = max(bound, best[-1] if len(best) == count else -np.inf)
            if beat > -np.inf and reach > limit * max(0.0, 2 - 2 * beat):
                break
        return best_at, best


def search_block(count: int, limit: float, seed: int):
    """For cogrouped applyInArrow: a block of rows and a block of queries to each query's nearest rows of the block."""

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if data.num_rows and queries.num_rows:
            dim = data.column("dim")[0].as_py()
            block = Block(data.column("row").to_numpy(), data.column("vec_id").to_numpy(), rows_of(data.column("vector"), dim), projection(dim, seed))
            vectors, bounds = rows_of(queries.column("vector"), dim), queries.column("bound").to_numpy()
            for row, query_id, q, bound in zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), vectors, bounds, strict=True):
                found, scores = block.nearest(row, q, count, limit, -np.inf if np.isnan(bound) else bound)
                for column, values in zip(out, ([row] * len(found), [query_id] * len(found), block.rows[found], block.ids[found], scores), strict=True):
                    column.extend(values)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["query_row", "query_id", "row", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def sampled_trees(rows: DataFrame, n: int, cell_rows: int, max_sample: int, seed: int) -> dict[int, CellTree]:
    """For each length of vectors, cells of about cell_rows rows, fitted on at most max_sample rows, eight to a cell at least."""
    sample = rows.sample(fraction=min(1.0, 1.5 * max_sample / max(1, n)), seed=seed).limit(max_sample).select("vector").toArrow().column(0).combine_chunks()
    dims = pc.list_value_length(sample).to_numpy(zero_copy_only=False)
    leaf = max(8, len(sample) * cell_rows // max(1, n))
    return {dim: CellTree(projected(sample.filter(pa.array(dims == dim)), dim, seed), leaf) for dim in np.unique(dims).tolist()}


def nearest(
    vectors: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    count: int = 5,
    share: float = 0.95,
    cell_rows: int = 16_384,
    block_queries: int = 4_096,
    max_sample: int = 50_000,
    seed: int = 20240,
) -> DataFrame:
    """query_id, rank, vec_id and score: the `count` rows of largest cosine found for each row that `queries` picks.

    The top of a kd-tree over projected unit vectors, fitted on at most max_sample rows, puts every row into a cell of
    about cell_rows; fuller cells are dealt into parts. A query is searched in its own cell first, on a kd-tree over all
    rows there, and takes the score of its count-th best to the other cells that may hold a better row. A search ends, and
    a cell is passed by, where a row nearer than the count-th best would lie beyond the projected distance reached with a
    chance of 1 - share at most. Rows go to more than one task only where more than block_queries queries meet their cell.

    Rows are told apart by their place in the table, not by id: a query's candidates are all rows but itself, so a row that
    repeats its id or its vector is a candidate like any other, and a repeated query is answered as often as it stands
    there. Ties go to the smaller id. Fewer candidates than count: all of them. Vectors of different lengths have no cosine
    and are no candidates of each other.

    Vectors that are null, empty or zero, or that hold null or non-finite components take no part; nor do rows with a null
    id. Empty table: empty result. Only id_col, vector_col and the columns of `queries` are read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.struct(F.col(id_col).cast("long").alias("id"), queries.alias("asked")).alias("vec_id"), F.col(vector_col).alias("vector"))
    n, limit = rows.count(), chi_square_point(share)
    kind = rows.schema["vector"].dataType.simpleString()
    trees = sampled_trees(rows, n, cell_rows, max_sample, seed)
    placed = rows.mapInArrow(place(trees, seed), f"vec_id struct<id: long, asked: boolean>, vector {kind}, dim int, cell long, point array<double>")
    own = (F.col("vec_id.id").alias("vec_id"), F.col("vec_id.asked").alias("asked"), F.monotonically_increasing_id().alias("row"))
    placed = scratch.keep(placed.select(*own, "vector", "dim", "cell", "point"), "placed")
    asked = placed.where("asked").drop("asked")

    corners = [f(F.col("point")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    # At most max_sample / 8 cells, and one for each length of vectors beyond the sample.
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), *corners).orderBy("dim", "cell").collect()
    boxes = {}
    for dim in {c["dim"] for c in cells}:
        own = [c for c in cells if c["dim"] == dim]
        low, high = (np.array([[c[f"{name}{i}"] for i in range(DIMENSIONS)] for c in own]) for name in ("low", "high"))
        boxes[dim] = (np.array([c["cell"] for c in own], dtype=np.int64), low, high)

    def search(wanted: DataFrame) -> DataFrame:
        loads = {(r["dim"], r["cell"]): r["n"] for r in wanted.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
        met = [(d, c, -(-n // cell_rows), -(-loads[d, c] // block_queries)) for d, c, n in ((c["dim"], c["cell"], c["n"]) for c in cells) if (d, c) in loads]
        # No more rows than there are cells.
        shape = F.broadcast(spark.createDataFrame(met, "dim int, cell long, parts long, lots long"))
        data = placed.select("row", "vec_id", "vector", "dim", "cell").join(shape, ["dim", "cell"])
        data = data.select("row", "vec_id", "vector", "dim", "cell", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))
        ask = wanted.join(shape, ["dim", "cell"])
        # New columns of the same names, since both sides come from one table.
        ask = ask.select(*(F.col(c).alias(c) for c in ("row", "vec_id", "vector", "bound", "dim", "cell")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("row", F.lit(1)), "lots").alias("lot"))
        keys = ("dim", "cell", "part", "lot")
        return data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(search_block(count, limit, seed), FOUND)

    first = scratch.keep(search(asked.withColumn("bound", F.lit(None).cast("double"))), "first")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    fullest = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    bounds = fullest.where(F.col("rank") == count).select(F.col("query_row").alias("row"), F.col("score").alias("bound"))
    others = asked.join(bounds, "row", "left").mapInArrow(open_cells(boxes, limit), f"row long, vec_id long, vector {kind}, dim int, bound double, cell long")
    found = fullest.drop("rank").union(search(others))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")
