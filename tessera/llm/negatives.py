"""Hard negatives by distance keys: augmented vectors sorted by (pivot, distance), scanned from a query's own key outwards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.neighbours import rows_of
from tessera.plans.scratch import Scratch

MET = "query_row long, band int, row long, id long, score double"


@dataclass
class Keys:
    """Pivots for vectors of one length, and the bounds of the annuli around each.

    A vector x gets one more component, sqrt(reach - |x|^2), where reach is the greatest squared length of any: then the
    nearer a row lies to (query, 0), the larger is its inner product with the query.
    """

    reach: float
    pivots: np.ndarray
    cuts: list[np.ndarray]

    @classmethod
    def fitted(cls, sample: np.ndarray, reach: float, count: int, leaf: int, seed: int) -> Keys:
        points = augmented(sample, reach)
        rng = np.random.default_rng(seed)
        pivots = points[rng.choice(len(points), min(count, len(points)), replace=False)]
        for _ in range(6):
            owner = distances(points, pivots).argmin(axis=1)
            pivots = np.stack([points[owner == i].mean(axis=0) if (owner == i).any() else pivots[i] for i in range(len(pivots))])
        far = distances(points, pivots)
        owner, key = far.argmin(axis=1), far.min(axis=1)
        cuts = [np.unique(np.sort(key[owner == i])[leaf::leaf]) for i in range(len(pivots))]
        return cls(reach, pivots, cuts)

    def first_cell(self, pivot: int) -> int:
        return sum(len(c) + 1 for c in self.cuts[:pivot])

    def places(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of each augmented point and its distance from its pivot."""
        far = distances(points, self.pivots)
        owner, key = far.argmin(axis=1), far.min(axis=1)
        cells = np.zeros(len(points), dtype=np.int64)
        for i in range(len(self.pivots)):
            own = owner == i
            cells[own] = self.first_cell(i) + np.searchsorted(self.cuts[i], key[own], side="right")
        return cells, key

    def pivot_of(self, cell: int) -> int:
        return int(np.searchsorted([self.first_cell(i) for i in range(len(self.pivots))], cell, side="right")) - 1


def vectors_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return rows_of(column, max(1, dim))


def augmented(vectors: np.ndarray, reach: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, reach - (vectors * vectors).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def as_queries(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def place(keys: dict[int, Keys]):
    """For mapInArrow: (id, label, asked, vector, dim) to the same with the row's annulus and key, and that of it as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                vectors, of = vectors_of(own.column("vector"), dim), keys[dim]
                cells, key = of.places(augmented(vectors, of.reach))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells), pa.array(key), pa.array(of.places(as_queries(vectors))[0])], names=[*batch.schema.names, "cell", "key", "ask_cell"])

    return run


def slack(reach: float, square: float) -> float:
    """More than rounding can do to a score worked out from distances."""
    return 1e-6 * (1 + reach + square)


def open_cells(keys: dict[int, Keys], cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """For mapInArrow: queries (searched in ask_cell, with bands and bounds) to the other annuli that may hold a better row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            bands = [batch.column(c).to_pylist() for c in ("lows", "highs", "bounds")]
            for i, (dim, own, vector) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("ask_cell").to_pylist(), batch.column("vector").to_pylist(), strict=True)):
                of, (numbers, pivots, low, high) = keys[dim], cells[dim]
                q = np.array(vector, dtype=np.float64)
                square = float(q @ q)
                far = distances(as_queries(q[None, :]), of.pivots)[0][pivots]
                near, apart = np.maximum(0.0, np.maximum(far - high, low - far)), far + high
                most = (square + of.reach - near**2) / 2 + slack(of.reach, square)
                least = (square + of.reach - apart**2) / 2 - slack(of.reach, square)
                wanted = np.zeros(len(numbers), dtype=bool)
                for a, b, bound in zip(*(x[i] for x in bands), strict=True):
                    wanted |= (most >= max(a, bound)) & (least <= b)
                to = numbers[wanted & (numbers != own)]
                rows.append(np.full(len(to), i))
                found.append(to)
            out = batch.drop_columns(["ask_cell"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(found))], names=[*out.schema.names, "cell"])

    return run


class Annulus:
    """Rows around one pivot, sorted by their distance from it."""

    def __init__(self, data: pa.Table, dim: int) -> None:
        order = np.argsort(data.column("key").to_numpy(), kind="stable")
        self.key, self.ids, self.rows, self.labels = (data.column(c).to_numpy()[order] for c in ("key", "id", "row", "label"))
        self.vectors = vectors_of(data.column("vector"), dim)[order]

    def scan(self, row: int, label: int, q: np.ndarray, far: float, reach: float, bands: list[tuple[float, float, float]], count: int, alike: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each band (low, high, bound) of scores the `count` best rows of the query's label, or of the others, in it.

        The interval of keys grows from the query's own distance to the pivot. No row outside it is nearer to the query than
        the distance that is left to its ends, so its score has a bound; the scan ends where that lies below what each band
        has or needs.
        """
        square = float(q @ q)
        best = [(np.empty(0, dtype=np.int64), np.empty(0)) for _ in bands]
        need = [max(low, bound) for low, _, bound in bands]
        begin = end = int(np.searchsorted(self.key, far))
        step = 512
        while begin > 0 or end < len(self.key):
            to, upto = max(0, begin - step), min(len(self.key), end + step)
            new = np.concatenate([np.arange(to, begin), np.arange(end, upto)])
            begin, end, step = to, upto, step * 2
            new = new[((self.labels[new] == label) == alike) & (self.rows[new] != row)]
            scores = self.vectors[new] @ q
            for i, (low, high, bound) in enumerate(bands):
                fit = (scores >= need[i]) & (scores <= high)
                if fit.any():
                    at, own = np.concatenate([best[i][0], new[fit]]), np.concatenate([best[i][1], scores[fit]])
                    order = np.lexsort((self.rows[at], self.ids[at], -own))[:count]
                    best[i] = at[order], own[order]
                    if len(order) == count:
                        need[i] = max(need[i], own[order[-1]])
            gap = min(far - self.key[begin - 1] if begin else np.inf, self.key[end] - far if end < len(self.key) else np.inf)
            if (square + reach - gap * gap) / 2 + slack(reach, square) < min(need):
                break
        return best


def search(keys: dict[int, Keys], count: int, alike: bool):
    """For cogrouped applyInArrow: rows of an annulus and queries to the best rows for each band of each query."""

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if data.num_rows and queries.num_rows:
            dim = data.column("dim")[0].as_py()
            of, annulus = keys[dim], Annulus(data, dim)
            vectors = vectors_of(queries.column("vector"), dim)
            far = distances(as_queries(vectors), of.pivots)[:, of.pivot_of(data.column("cell")[0].as_py())]
            columns = [queries.column(c).to_pylist() for c in ("row", "label", "lows", "highs", "bounds")]
            for row, label, lows, highs, bounds, q, distance in zip(*columns, vectors, far, strict=True):
                for band, (at, scores) in enumerate(annulus.scan(row, label, q, distance, of.reach, list(zip(lows, highs, bounds, strict=True)), count, alike)):
                    for column, values in zip(out, ([row] * len(at), [band] * len(at), annulus.rows[at], annulus.ids[at], scores), strict=True):
                        column.extend(values)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["query_row", "band", "row", "id", "score"])

    return run


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    pivots: int = 16,
    cell_rows: int = 16_384,
    block_queries: int = 4_096,
    max_sample: int = 50_000,
    seed: int = 20250,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Components x become floor(scale * x); a row's score is its inner product with the anchor, higher first, ties by smaller
    id. The positives of a row that `anchors` picks are its `positives` first other rows of its label. For each of them come
    the first `negatives` rows of other labels whose score lies between low and high percent of the positive's.

    Vectors get one more component that makes the largest inner product the least distance. Pivots and the bounds of
    annuli around them are fitted on at most max_sample rows; each row's key is its distance from its nearest pivot, and an
    annulus holds about cell_rows of one pivot (fuller ones are dealt into parts), sorted by key. A query scans its own
    annulus from its own distance on outwards; what it finds bounds the other annuli that can hold a better row, and only
    those are scanned, each until the distance left shows that nothing better follows. So results are exact. Where vectors
    lie at like distances from each other nearly all annuli stay open, and the work is that of anchors times rows.

    Of equal vectors with one label only the first by id can be among the first of a query, and only so many as it takes:
    the others are left out before the search, so a vector that very many rows share costs no more than a few.

    Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Empty vectors have the
    score 0 with each other; vectors of different lengths are no candidates of each other. Repeated rows: each is a
    candidate, and a repeated anchor is answered as often as it stands there. Fewer rows than asked for: all. Scores are
    exact up to 2^53 and rounded as doubles beyond. Empty table: empty result. Only id_col, vector_col, label_col and the
    columns of `anchors` are read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    # An empty vector stands as one of a single zero, told apart by its length.
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
        F.when(F.size(vector) == 0, F.array(F.lit(0.0))).otherwise(whole).alias("vector"),
        F.size(vector).alias("dim"),
    )
    square = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    # One row for each length of vectors.
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("reach")).collect()
    n = sum(r["n"] for r in sizes)
    sample = rows.sample(fraction=min(1.0, 1.5 * max_sample / max(1, n)), seed=seed).limit(max_sample).select("dim", "vector").toArrow()
    leaf, keys = max(8, sample.num_rows * cell_rows // max(1, n)), {}
    for r in sizes:
        own = sample.filter(pc.equal(sample.column("dim"), r["dim"]))
        known = vectors_of(own.column("vector"), r["dim"]) if own.num_rows else np.zeros((1, max(1, r["dim"])))
        keys[r["dim"]] = Keys.fitted(known, r["reach"], pivots, leaf, seed)
    kind = "id long, label long, asked boolean, vector array<double>, dim int, cell long, key double, ask_cell long"
    placed = scratch.keep(rows.mapInArrow(place(keys), kind).withColumn("row", F.monotonically_increasing_id()), "placed")
    alike = Window.partitionBy("dim", "vector", "label").orderBy("id", "row")
    first = placed.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= max(positives + 1, negatives))
    first = scratch.keep(first.select("row", "id", "label", "vector", "dim", "cell", "key"), "first")

    # At most max_sample / 8 annuli, and some for each length of vectors.
    cells = first.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("dim", "cell").collect()
    bounds = {}
    for dim in keys:
        own = [c for c in cells if c["dim"] == dim]
        numbers = np.array([c["cell"] for c in own], dtype=np.int64)
        pivot_of = np.array([keys[dim].pivot_of(c["cell"]) for c in own], dtype=np.int64)
        bounds[dim] = (numbers, pivot_of, np.array([c["low"] for c in own]), np.array([c["high"] for c in own]))

    def scanned(wanted: DataFrame, count: int, alike: bool) -> DataFrame:
        loads = {(r["dim"], r["cell"]): r["n"] for r in wanted.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
        met = [(d, c, -(-n // cell_rows), -(-loads[d, c] // block_queries)) for d, c, n in ((c["dim"], c["cell"], c["n"]) for c in cells) if (d, c) in loads]
        # No more rows than there are annuli.
        shape = F.broadcast(spark.createDataFrame(met, "dim int, cell long, parts long, lots long"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        data = first.join(shape, ["dim", "cell"]).select("row", "id", "label", "vector", "key", "dim", "cell", F.pmod(F.xxhash64("row"), "parts").alias("part"), each("lots").alias("lot"))
        # New columns of the same names, since both sides come from one table.
        own = (F.col(c).alias(c) for c in ("row", "label", "vector", "lows", "highs", "bounds", "dim", "cell"))
        ask = wanted.join(shape, ["dim", "cell"]).select(*own, each("parts").alias("part"), F.pmod(F.xxhash64("row", F.lit(1)), "lots").alias("lot"))
        by = ("dim", "cell", "part", "lot")
        return data.groupBy(*by).cogroup(ask.groupBy(*by)).applyInArrow(search(keys, count, alike), MET)

    def best(queries: DataFrame, count: int, alike: bool, name: str) -> DataFrame:
        """The `count` best rows for each band of queries (row, label, vector, dim, ask_cell, lows, highs)."""
        order = Window.partitionBy("query_row", "band").orderBy(F.desc("score"), "id", "row")
        ranked = lambda met: met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
        none = F.transform("lows", lambda x: F.lit(float("-inf")))
        near = scratch.keep(ranked(scanned(queries.withColumn("bounds", none).withColumnRenamed("ask_cell", "cell"), count, alike)), f"{name}-near")
        full = near.where(F.col("rank") == count).groupBy("query_row").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("full"))
        known = queries.join(full, queries["row"] == full["query_row"], "left")
        bounded = known.withColumn("bounds", F.transform("lows", lambda x, i: F.coalesce(F.col("full")[i], F.lit(float("-inf")))))
        kind = "row long, label long, vector array<double>, dim int, lows array<double>, highs array<double>, bounds array<double>, cell long"
        others = bounded.select("row", "label", "vector", "dim", "lows", "highs", "bounds", "ask_cell").mapInArrow(open_cells(keys, bounds), kind)
        # Read once to be counted and once to be searched.
        others = scratch.keep(others, f"{name}-others")
        return ranked(near.drop("rank").union(scanned(others, count, alike)))

    asked = placed.where("asked").select("row", "id", "label", "vector", "dim", "ask_cell")
    ends = lambda x: F.array(F.lit(x))
    queries = asked.select("row", "label", "vector", "dim", "ask_cell", ends(float("-inf")).alias("lows"), ends(float("inf")).alias("highs"))
    found = scratch.keep(best(queries, positives, True, "positives"), "positives")
    # 30 * positive <= 100 * negative <= 90 * positive, in whole numbers.
    usable = found.where(F.col("score") >= 0).withColumn("from", F.ceil(F.col("score") * low / 100).cast("double")).withColumn("to", F.floor(F.col("score") * high / 100).cast("double"))
    bands = usable.groupBy(F.col("query_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "from", "to", "id", "score"))).alias("b"))
    queries = asked.join(bands, "row").select("row", "label", "vector", "dim", "ask_cell", F.col("b.from").alias("lows"), F.col("b.to").alias("highs"))
    mined = best(queries, negatives, False, "negatives")
    pairs = bands.select("row", F.posexplode("b").alias("band", "p")).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    pairs = pairs.select(F.col("row").alias("query_row"), "band", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").cast("long").alias("positive_score"))
    out = mined.join(pairs, ["query_row", "band"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))
