"""Hard negatives against all pairs, on spread, clustered and repeated vectors and on odd rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.negatives import Annulus, Keys, augmented, hard_negatives

TABLE = "vec_id long, embedding array<double>, label int"


def plain(rows, asked, positives=5, negatives=10):
    """All answers from all pairs; rows: (id, vector, label)."""
    whole = [(i, [int(np.floor(256 * float(x))) for x in v], k) for i, v, k in rows if i is not None and v is not None and k is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, q, k) in enumerate(whole):
        if not asked(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, m) for m, (j, v, _) in enumerate(whole) if m != n and len(v) == len(q))
        for s, p, m in [x for x in scored if whole[x[2]][2] == k][:positives]:
            found = [(t, j) for t, j, o in scored if whole[o][2] != k and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out.update((i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(found))
    return out


def table(n, width, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    data = (spread * rng.normal(size=(n, width)) + (1 - spread) * 3 * centres[rng.integers(0, 6, n)]).astype(np.float32).astype(float)
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(data, rng.integers(0, labels, n), strict=True))]


def check(spark, rows, every=10, **options):
    got = hard_negatives(spark.createDataFrame(rows, TABLE).withColumn("rank", F.lit("clash")).withColumn("row", F.lit("clash")), F.col("vec_id") % every == 0, **options)
    want = plain(rows, lambda i: i % every == 0)
    assert Counter(map(tuple, got.collect())) == want
    return want


def test_spread_and_clustered_vectors(spark):
    assert len(check(spark, table(400, 12, 4, 1), cell_rows=30, pivots=5, block_queries=9)) > 500
    assert len(check(spark, table(500, 6, 3, 2, spread=0.1), cell_rows=40, pivots=6)) > 500


def test_repeated_vectors_and_ties(spark):
    rows = table(200, 4, 3, 3)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, k) for i, v, k in rows] + [rows[0]] * 3 + [(10, rows[5][1], 1)] * 2
    # Components of one step give many equal scores.
    rows += [(1000 + i, [float(x) for x in np.random.default_rng(i).integers(0, 2, 4)], i % 3) for i in range(100)]
    assert len(check(spark, rows, cell_rows=50, pivots=4)) > 500


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.5, 0.1], 2), (3, [0.4, 0.3], 2), (10, [0.0, 0.0], 2), (11, [-0.0, 0.001], 1)]
    rows += [(20, None, 1), (30, [1.0, 1.0], None), (40, [float("nan"), 1.0], 1), (50, [None, 1.0], 2), (60, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 2)]
    rows += [(70, [], 1), (71, [], 1), (72, [], 2), (80, [3.0], 1), (81, [2.0], 1), (82, [1.0], 2), (90, [-5.0, 1.0, 0.0], 1), (91, [5.0, 1.0, 0.0], 1)]
    want = check(spark, rows)
    assert (70, 71, 1, 72, 0, 0) in want and any(r[0] == 80 for r in want) and any(r[0] == 0 for r in want)
    assert hard_negatives(spark.createDataFrame([], TABLE), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(spark.createDataFrame(rows, TABLE), F.col("vec_id") < 0).count() == 0


def test_query(spark, tmp_path):
    rows = table(300, 8, 10, 7) + [(7000, [0.5] * 8, None), (8000, None, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    turned = [(i, v, k if k is None or i % 7 else (k + 1) % 10) for i, v, k in rows]
    got = queries.QUERIES["op11_distance_key_negatives"](spark, str(tmp_path)).collect()
    want = plain(turned, lambda i: i % 100 == 0)
    assert Counter(map(tuple, got)) == want and len(want) > 20


def test_a_scan_ends_before_the_last_row():
    """Vectors along one line: their keys order them, so a scan certifies its best rows after its first intervals."""
    data = np.arange(20_000.0)[:, None]
    points = augmented(data, 19_999.0**2)
    keys = Keys(19_999.0**2, points[-1:], [np.empty(0)])
    table = pa.table({"key": keys.places(points)[1], "id": np.arange(20_000), "row": np.arange(20_000), "label": np.zeros(20_000, dtype=int), "vector": pa.array(data.tolist())})
    annulus, seen = Annulus(table, 1), []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(self)[at]

    annulus.vectors = annulus.vectors.view(Watched)
    q = np.array([19_999.0])
    [(at, scores)] = annulus.scan(-1, 0, q, 0.0, keys.reach, [(-np.inf, np.inf, -np.inf)], 5, True)
    assert annulus.ids[at].tolist() == [19_999, 19_998, 19_997, 19_996, 19_995] and sum(seen) < 2000
