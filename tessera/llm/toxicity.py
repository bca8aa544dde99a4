"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch
from tessera.llm.words import grouped_texts

TERM = re.compile(r"[^\W\d_]+")


class TermNumbers(dict):
    """Hashed numbers of terms, or their places among the features of a model (-1: none)."""

    def __init__(self, bits: int, features: np.ndarray | None = None, most: int = 300_000) -> None:
        self.mask, self.features, self.most = (1 << bits) - 1, features, most

    def __missing__(self, term: str) -> int:
        if len(self) >= self.most:
            self.clear()
        number = zlib.crc32(term.encode()) & self.mask
        if self.features is not None:
            at = int(np.searchsorted(self.features, number))
            number = at if at < len(self.features) and self.features[at] == number else -1
        self[term] = number
        return number

    def of(self, text: str) -> np.ndarray:
        terms = TERM.findall(text.lower())
        found = np.unique(np.fromiter(map(self.__getitem__, terms), dtype=np.int32, count=len(terms)))
        return found[np.searchsorted(found, 0) :]


@dataclass
class FactorizationMachine:
    """score = bias + sum of weights + sum over pairs of terms of the dot products of their factors, through a logistic."""

    features: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        ids = np.concatenate([*rows, np.empty(0, dtype=np.int32)]).astype(np.int64)
        return 1 / (1 + np.exp(-np.clip(raw_scores(self.bias, self.weights, self.factors, ids, sizes)[0], -30, 30)))


def row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many values; 0 for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def raw_scores(bias: float, weights: np.ndarray, factors: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores before the logistic; each row's factor sums; the factors of its terms.

    The sum over all pairs of a row's terms is half of what the squared sum of their factors has beyond the sum of squares.
    """
    own = factors[ids]
    sums = row_sums(own, sizes)
    pairs = 0.5 * (sums**2 - row_sums(own**2, sizes)).sum(axis=1)
    return bias + row_sums(weights[ids], sizes) + pairs, sums, own


def fit(
    features: np.ndarray,
    rows: list[np.ndarray],
    labels: np.ndarray,
    *,
    rank: int = 8,
    epochs: int = 30,
    batch: int = 512,
    rate: float = 0.2,
    decay: float = 2e-4,
    seed: int = 11,
) -> FactorizationMachine:
    """Logistic loss by AdaGrad over fixed batches."""
    rng = np.random.default_rng(seed)
    n = len(features)
    weights, factors = np.zeros(n), rng.normal(0, 0.01, (n, rank))
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    seen_w, seen_f, seen_b = np.full(n, 1e-6), np.full((n, rank), 1e-6), 1e-6
    order = rng.permutation(len(rows))
    batches = []
    for at in range(0, len(rows), batch):
        picked = order[at : at + batch]
        sizes = np.fromiter((len(rows[i]) for i in picked), dtype=np.int64, count=len(picked))
        ids = np.concatenate([rows[i] for i in picked]).astype(np.int64) if sizes.sum() else np.empty(0, dtype=np.int64)
        by = np.argsort(ids, kind="stable")
        terms, counts = np.unique(ids, return_counts=True)
        batches.append((labels[picked].astype(float), sizes, ids, by, terms, counts))
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            y, sizes, ids, by, terms, counts = batches[i]
            raw, sums, own = raw_scores(bias, weights, factors, ids, sizes)
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(y)
            each = np.repeat(off, sizes)
            g_w = row_sums(each[by], counts) + decay * weights[terms]
            g_f = row_sums((each[:, None] * (np.repeat(sums, sizes, axis=0) - own))[by], counts) + decay * factors[terms]
            g_b = off.sum()
            seen_w[terms] += g_w**2
            seen_f[terms] += g_f**2
            seen_b += g_b**2
            weights[terms] -= rate * g_w / np.sqrt(seen_w[terms])
            factors[terms] -= rate / 5 * g_f / np.sqrt(seen_f[terms])
            bias -= rate * g_b / seen_b**0.5
    return FactorizationMachine(features, bias, weights.astype(np.float32), factors.astype(np.float32))


def held_out(id_col: str) -> Column:
    """Whether a row's labels are not for learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hashed_terms(bits: int):
    """For mapInArrow: (struct of id and label, text) to (id, label, numbers of the distinct terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TermNumbers(bits)
        for keys, texts in grouped_texts(batches):
            terms = [numbers.of(t) for t in texts.to_pylist()]
            ids, labels = [k["id"] for k in keys], [k["label"] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(labels, pa.int32()), pa.array(terms, pa.list_(pa.int32()))], names=["id", "label", "terms"])

    return run


def interacting(flat: np.ndarray, sizes: np.ndarray, label: np.ndarray, numbers: np.ndarray, deviation: float, most: int = 2_000_000) -> np.ndarray:
    """Terms of pairs whose share of toxic rows departs by so many standard deviations from what their two terms tell.

    Rows hold sorted distinct terms. Of each term of numbers, all pairs with later terms are counted. What two terms tell is
    the sum of their log odds; the departure is the signed root of the deviance, since rare pairs are far from normal. Pairs
    of a term are counted about `most` at a time, or those of one row.
    """
    n_terms = int(flat.max()) + 1 if len(flat) else 0
    order = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[order], np.arange(n_terms + 1))
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    ends, toxic = np.cumsum(sizes), label > 0
    total = np.diff(bounds)
    prior = np.clip(toxic.mean() if len(toxic) else 0.5, 1e-6, 1 - 1e-6)
    rate = (np.bincount(flat, weights=toxic[row], minlength=n_terms) + prior) / (total + 1)
    odds, base = np.log(rate / (1 - rate)), np.log(prior / (1 - prior))
    found = []
    for a in numbers[numbers < n_terms]:
        at = order[bounds[a] : bounds[a + 1]]
        left = ends[row[at]] - at - 1
        parts = np.searchsorted(np.cumsum(left), np.arange(most, left.sum(), most))
        n = c = b = None
        for at_part, left_part in zip(np.split(at, parts), np.split(left, parts), strict=True):
            skip = np.cumsum(left_part) - left_part
            others = flat[np.arange(left_part.sum()) + np.repeat(at_part + 1 - skip, left_part)]
            hit = np.repeat(toxic[row[at_part]], left_part)
            if not len(parts) and len(others) < n_terms:
                b, places, n = np.unique(others, return_inverse=True, return_counts=True)
                c = np.bincount(places[hit], minlength=len(b))
            else:
                n = np.bincount(others, minlength=n_terms) + (0 if n is None else n)
                c = np.bincount(others[hit], minlength=n_terms) + (0 if c is None else c)
        if b is None:
            b = np.flatnonzero(n)
            n, c = n[b], c[b]
        p = np.clip(1 / (1 + np.exp(-(odds[a] + odds[b] - base))), 1e-6, 1 - 1e-6)
        with np.errstate(divide="ignore", invalid="ignore"):
            deviance = 2 * (np.where(c > 0, c * np.log(c / (n * p)), 0) + np.where(c < n, (n - c) * np.log((n - c) / (n * (1 - p))), 0))
        b = b[deviance >= deviation**2]
        if len(b):
            found += [[a], b]
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


def interacting_terms(spark: SparkSession, flat: np.ndarray, sizes: np.ndarray, label: np.ndarray, deviation: float, tasks: int = 24) -> np.ndarray:
    """interacting() for all terms, each task taking every so manieth of them."""
    sample = spark.sparkContext.broadcast((flat.astype(np.int32), sizes, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, marks = sample.value
        n_terms = int(own.max()) + 1 if len(own) else 0
        for batch in batches:
            for first in batch.column(0).to_pylist():
                terms = interacting(own, rows, marks, np.arange(first, n_terms, tasks), deviation)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64())], names=["term"])

    # At most one row for each term of the sample and task.
    found = spark.range(0, tasks, 1, tasks).mapInArrow(run, "term long").distinct().toArrow()
    return np.sort(found.column("term").to_numpy())


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    bits: int = 20,
    max_rows: int = 20_000,
    max_terms: int = 20_000_000,
    min_docs: int = 4,
    min_deviation: float = 5.0,
    min_pair_deviation: float = 6.0,
    seed: int = 11,
) -> FactorizationMachine:
    """A model from at most max_rows labelled rows, which the hashes of their ids pick, none of them held out; of very long
    texts as many, in that order, as have max_terms distinct terms together.

    Only that bounded sample's hashed terms reach the driver. Features are terms of min_docs sampled documents at least whose
    share among toxic ones departs from their share among the others by min_deviation standard deviations, or which are in a
    pair that departs by min_pair_deviation from what its two terms tell; all pairs are tested, so terms that tell nothing
    alone come in by their pairs. Without any labelled row every score is one half. Of documents that share an id the one
    with the smallest list of terms counts.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    picked = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label")).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(max_rows)
    # At most max_rows rows of an id and a label.
    sampled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked.withColumnRenamed(id_col, "__id")), "__id")
    sampled = sampled.select(F.struct(F.col("__id").cast("string").alias("id"), F.col("__label").alias("label")).alias("key"), "text")
    terms = sampled.mapInArrow(hashed_terms(bits), "id string, label int, terms array<int>")
    # A row for each id, of whatever number of documents share it.
    single = terms.groupBy("id").agg(F.first("label").alias("label"), F.min("terms").alias("terms"))
    kept = Scratch(spark, "toxicity").keep(single.withColumn("place", F.xxhash64("id", F.lit(seed))), "sample")
    # At most max_rows rows of numbers.
    upto = kept.select("place", "id", F.sum(F.size("terms")).over(Window.orderBy("place", "id")).alias("upto"))
    rows = kept.join(upto, ["place", "id"]).where(F.col("upto") <= max_terms).select("label", "terms").toArrow()
    lists = rows.column("terms").combine_chunks()
    flat = (lists.flatten() if len(rows) else pa.array([], pa.int32())).to_numpy()
    sizes = np.diff(lists.offsets.to_numpy()) if len(rows) else np.empty(0, dtype=np.int64)
    label = rows.column("label").to_numpy()
    counts = np.bincount(flat, minlength=1)
    toxic = np.bincount(flat, weights=np.repeat(label > 0, sizes), minlength=1)
    ones = max(1, int((label > 0).sum()))
    others = max(1, len(label) - ones)
    share = counts / max(1, len(label))
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / others))
    apart = np.abs(toxic / ones - (counts - toxic) / others) / error
    frequent = np.flatnonzero(counts >= min_docs)
    places = np.full(len(counts), -1, dtype=np.int32)
    places[frequent] = np.arange(len(frequent))
    known = places[flat] >= 0
    held = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
    paired = frequent[interacting_terms(spark, places[flat][known], held, label, min_pair_deviation)] if known.any() else frequent[:0]
    features = np.union1d(frequent[apart[frequent] >= min_deviation], paired)
    places = np.full(len(counts), -1, dtype=np.int32)
    places[features] = np.arange(len(features))
    terms = [t[t >= 0] for t in np.split(places[flat], np.cumsum(sizes)[:-1])] if len(rows) else []
    # Rows come in no fixed order.
    order = sorted(range(len(terms)), key=lambda i: (label[i], terms[i].tobytes()))
    return fit(features.astype(np.int64), [terms[i] for i in order], label[order], seed=seed)


def score(docs: DataFrame, model: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 20) -> DataFrame:
    """(doc_id, score) for each row of docs; a null text counts as an empty one, whose score is that of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        numbers = TermNumbers(bits, machine.features)
        for keys, texts in grouped_texts(batches):
            scores = machine.score([numbers.of(t) for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score reaches the threshold) for each row of docs.

    The model's only input is the text. Null or empty text: the score of no terms. Null doc_id: scored, not held out.
    Repeated labels of a document: the largest counts. Empty tables: empty result, or a score of the prior alone. Other
    columns of docs do not matter.
    """
    scored = score(docs, train(docs, labels, **options), **{k: v for k, v in options.items() if k in ("id_col", "text_col", "bits")})
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
