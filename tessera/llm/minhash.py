"""Near-duplicate documents by b-bit MinHash: bands propose pairs, packed low bits screen them, full sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch
from tessera.llm.words import grouped_bytes

# Texts of similarity 0.8 share none of the bands with probability 6e-7, of 0.85 with 7e-10.
HASHES, BITS, BANDS, ROWS = 256, 2, 36, 5
FINE = 2048
# Classes of one band that one task compares with as many.
BLOCK = 1024
MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
OFFSETS = np.random.default_rng(20240301).integers(0, 2**32, HASHES, dtype=np.uint32)
POSITIONS = (np.random.default_rng(20240302).integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SIGNATURES = "doc_id long, n_shingles long, set_key binary, bits array<long>, bands array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, worked out when first asked for."""

    def __init__(self, most: int = 300_000) -> None:
        import xxhash

        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: list[bytes], hashes: WordHashes, length: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `length` words; of the whole, if there are fewer; none, if no words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h, n = hashes.of(words), min(length, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total += h[i : i + len(total)] * POSITIONS[i]
    return np.unique(mixed(total))


def minima(grams: np.ndarray, multipliers: np.ndarray = MULTIPLIERS, offsets: np.ndarray = OFFSETS) -> np.ndarray:
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), 2**32 - 1, dtype=np.uint32)
    step = max(1, 2**19 // len(multipliers))
    for at in range(0, len(x), step):
        each = multipliers[:, None] * x[None, at : at + step]
        each += offsets[:, None]
        np.minimum(least, each.min(axis=1), out=least)
    return least


def packed_bits(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each row of minima, their low bits in 64-bit words; a bijection goes before, as a linear hash has poor low bits."""
    low = (mixed(least.astype(np.uint64)) & np.uint64(2**bits - 1)).reshape(len(least), -1, 64 // bits)
    return np.bitwise_or.reduce(low << np.arange(0, 64, bits, dtype=np.uint64), axis=2).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[:, : BANDS * ROWS].astype(np.uint64).reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key.view(np.int64)


def list_column(matrix: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists, null where not present."""
    ends = np.concatenate([[0], np.cumsum(present * matrix.shape[1])]).astype(np.int32)
    offsets = pa.array(ends, mask=np.append(~present, False))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix[present].reshape(-1)))


def sign(length: int):
    """For mapInArrow: (doc_id, text) to rows of SIGNATURES; a document without words has no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for keys, texts in grouped_bytes(batches):
            sets = [shingles(t.lower().split(), hashes, length) for t in texts]
            least = np.stack([minima(s) for s in sets])
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [pa.array(keys, pa.int64()), pa.array(sizes), pa.array(digests, pa.binary())]
            columns += [list_column(m, sizes > 0) for m in (packed_bits(least), band_keys(least))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "bits", "bands"])

    return run


def fine_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (node, grams) to (node, one bit of each of FINE minima)."""
    rng = np.random.default_rng(20240303)
    multipliers, offsets = rng.integers(1, 2**32, FINE, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, FINE, dtype=np.uint32)
    for batch in batches:
        sets = [g.values.to_numpy().view(np.uint64) for g in batch.column("grams")]
        if sets:
            fine = packed_bits(np.stack([minima(g, multipliers, offsets) for g in sets]), 1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), list_column(fine, np.ones(len(fine), dtype=bool))], names=["node", "fine"])


def full_sets(length: int):
    """For mapInArrow: (node, text) to (node, shingle hashes), where the node is the key of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for keys, texts in grouped_bytes(batches):
            found = [(k, s) for k, t in zip(keys, texts, strict=True) if xxhash.xxh3_128_digest((s := shingles(t.lower().split(), hashes, length)).tobytes()) == k]
            if found:
                nodes, sets = zip(*found, strict=True)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), grams], names=["node", "grams"])

    return run


def confirm(percent: int):
    """For mapInArrow: (a, b, their sets) to the pairs (a, b) whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def estimated(bits_a: Column, bits_b: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from packed bits: matching groups of one or two bits, less those that match by chance."""
    apart = F.lit(0)
    for i in range(hashes * bits // 64):
        differ = F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i)))
        if bits == 2:
            differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
        apart = apart + F.bit_count(differ)
    chance = 1 / 2**bits
    return (1 - apart / F.lit(float(hashes)) - chance) / (1 - chance)


def safe_cut(percent: int, hashes: int, bits: int) -> float:
    """Five standard deviations of an estimate below the threshold."""
    chance = 1 / 2**bits
    match = percent / 100 * (1 - chance) + chance
    return percent / 100 - 5 * (match * (1 - match) / hashes) ** 0.5 / (1 - chance)


def sides(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of `length`-word shingles, and a component
    is all that links reach; component_id is its smallest doc_id, and the row with that doc_id is kept. ASCII letters are
    lower-cased first.

    Equal sets form one class, so copies are never paired. In each band a class is compared with the band's first class
    only (its hub); pairs that packed bits put near enough are confirmed on full sets and give first components. What is
    left are bands with classes of several components: of those, classes pair up only where their bits, two thousand more,
    and the shingles that no other class has still allow a link, and every such pair is confirmed too. So no link between classes that share a
    band is lost, while bands full of near copies stay linear.

    Null or empty text, or text without words: an empty set, linked with nothing. Null doc_id: linked with nothing, kept.
    Repeated rows: copies of each other; rows with the component's doc_id are all kept. Empty table: empty result. Only
    id_col and text_col are read, so other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.keep(source.mapInArrow(sign(length), SIGNATURES), "signed")
    linkable = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.keep(
        linkable.groupBy(F.col("set_key").alias("node")).agg(
            F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = scratch.keep(banded.join(hubs.select("key", "hub"), "key"), "shared")

    near = estimated(F.col("bits_a"), F.col("bits_b")) >= safe_cut(percent, HASHES, BITS)
    nearer = estimated(F.col("fine_a"), F.col("fine_b"), FINE, 1) >= safe_cut(percent, FINE, 1)
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    slim = classes.select("node", "n", "bits")

    pairs = shared.where("node <> hub").select(F.col("hub").alias("node_a"), F.col("node").alias("node_b")).distinct()
    pairs = pairs.join(sides(slim, "a"), "node_a").join(sides(slim, "b"), "node_b").where(near & sizes)
    pairs = scratch.keep(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "pairs-0")

    wanted = shared.select("node").distinct().join(classes.select("node", "low"), "node")
    texts = source.join(wanted.withColumnRenamed("low", "doc_id"), "doc_id").select("node", "text")
    sets = scratch.keep(texts.mapInArrow(full_sets(length), "node binary, grams array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
        b = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(confirm(percent), "a binary, b binary")

    first = scratch.keep(confirmed(pairs), "links-0")
    labels = connected_components(first, scratch, "components-0")

    # Classes whose own shingles alone rule out any link take no further part.
    alone = sets.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("times"), F.min("node").alias("node"))
    own = alone.where("times = 1").groupBy("node").agg(F.count("*").alias("own"))
    among = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = among.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("x <> y")
    open_classes = (
        classes.select("node", "n", "bits", "bands")
        .join(own, "node", "left")
        .withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
        .where(100 * F.col("common") >= percent * F.col("n"))
        .drop("own")
    )
    # Many near copies of one text lie just below the threshold; more bits tell most of them apart without their sets.
    finer = sets.join(open_classes.select("node"), "node", "left_semi").mapInArrow(fine_bits, "node binary, fine array<long>")
    open_classes = open_classes.join(finer, "node")
    rest = scratch.keep(among.drop("hub").join(split.select("key", "blocks"), "key").join(open_classes, "node"), "rest")
    most = F.least("common_a", "common_b")
    possible = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    earlier = F.exists(F.sequence(F.lit(0), F.col("band_a") - 1), lambda i: F.get("bands_a", i) == F.get("bands_b", i))
    meets_first_here = F.when(F.col("band_a") > 0, ~earlier).otherwise(F.lit(True))
    # A band of many classes is cut by their keys, which are hashes, and each two of its blocks meet in a place of their own.
    digest = F.conv(F.hex(F.substring("node", 1, 3)), 16, 10).cast("long")
    rest = rest.withColumn("block", F.floor(digest * F.col("blocks") / 2**24))
    a = sides(rest.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))), "a")
    b = sides(rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block")))), "b")
    crossing = a.join(
        b,
        (F.col("key_a") == F.col("key_b"))
        & (F.col("block_a") == F.col("other_b"))
        & (F.col("other_a") == F.col("block_b"))
        & (F.col("node_a") < F.col("node_b"))
        & (F.col("component_a") != F.col("component_b"))
        & sizes
        & possible
        & near
        & nearer
        & meets_first_here,
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    # Pairs with a hub that the first round has tested need no second test.
    crossing = scratch.keep(crossing.join(pairs, ["a", "b"], "left_anti"), "pairs-1")
    second = scratch.keep(confirmed(crossing), "links-1")
    if second.limit(1).count():
        scratch.drop("components-0")
        labels = connected_components(first.union(second), scratch, "components-1")
    members = classes.select("node", "low").join(labels, "node")
    lowest = members.groupBy("component").agg(F.min("low").alias("component_id"))
    found = scratch.keep(members.join(lowest, "component").select("node", "component_id"), "found")
    of_class = classes.select("node", "low").join(found, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    scratch.drop("shared", "pairs-0", "sets", "links-0", "rest", "pairs-1", "links-1")
    rows = signed.select("doc_id", "n_shingles", "set_key").join(of_class, (F.col("set_key") == F.col("node")) & F.col("doc_id").isNotNull(), "left")
    rows = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
