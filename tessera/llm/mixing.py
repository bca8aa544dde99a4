"""Mixing of sources to target weights: fixed-length blocks of words, dealt by pseudorandom permutations of each source."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.quality import bind, quoted, split_words
from tessera.plans.scratch import Scratch

#: Shards first draw from groups of so many sources, and a task then draws within each group.
SOURCES_OF_A_GROUP = 4096
#: A source is cut into so many blocks at least, if it has the words: small sources into blocks of few words.
BLOCKS_OF_A_SOURCE = 256


def shard_counts(quotas: np.ndarray, shard: int | Iterable[int], seed: int) -> np.ndarray:
    """Blocks of each source in each shard of `shard` slots (or of each of those sizes): multinomial draws by what each source has left.

    A draw takes no more than is left, and what it lacks comes from the sources with most left, so that the shards
    together hold exactly the quotas.
    """
    rng, left, rows = np.random.default_rng(seed), quotas.astype(np.int64).copy(), []
    sizes = repeat(shard) if isinstance(shard, int) else iter(shard)
    while (total := int(left.sum())) > 0:
        size = min(int(next(sizes)), total)
        drawn = np.minimum(rng.multinomial(size, left / total), left)
        lack = size - int(drawn.sum())
        for i in np.argsort(-(left - drawn), kind="stable"):
            if not lack:
                break
            more = min(lack, int(left[i] - drawn[i]))
            drawn[i] += more
            lack -= more
        rows.append(drawn)
        left -= drawn
    return np.array(rows, dtype=np.int64).reshape(len(rows), len(quotas))


def permuted(index: Column, size: Column, key: Column, rounds: int = 16) -> Column:
    """Place of index in a pseudorandom permutation of 0 .. size - 1: swap-or-not rounds, which suit any size."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(key, r) - x, size)
        swap = F.xxhash64(F.greatest(x, partner), key, r).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, step)


def measured(docs: DataFrame, scratch: Scratch, text_col: str, source_col: str, id_col: str, keep_text: bool) -> DataFrame:
    """Rows with a number of their own, their id, source and size in words, and all columns of docs in `doc` if wanted."""
    size = F.size(split_words(F.coalesce(F.col(text_col), F.lit("")))).cast("bigint")
    whole = [F.struct(*map(quoted, docs.columns)).alias("doc")] if keep_text else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("tie"), *whole)
    return scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def places(rows: DataFrame, sources: DataFrame, scratch: Scratch, bucket_rows: int) -> DataFrame:
    """(row, id, size, src, source_size, target, block, blocks, begin): where each row's words begin in its source.

    Sizes are summed within buckets of about bucket_rows rows, by hash of id and text, and then over buckets. Of more equal
    rows than a bucket has, each bucket_rows of the table make a bucket.
    """
    buckets = max(1, rows.count() // bucket_rows)
    slim = rows.select("id", "source", "size", "tie", "row").join(sources.drop("slots"), F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    many = slim.groupBy("src", F.xxhash64("id", "tie").alias("same")).agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).drop("n").withColumn("hot", F.lit(True))
    slim = slim.withColumn("same", F.xxhash64("id", "tie")).join(many, ["src", "same"], "left")
    part = F.when(F.col("hot"), F.expr(f"row div {bucket_rows}")).otherwise(F.lit(-1).cast("long"))
    slim = slim.withColumn("part", part).withColumn("bucket", F.pmod(F.col("same"), F.lit(buckets))).drop("hot", "same")
    before = Window.partitionBy("src").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = slim.groupBy("src", "bucket", "part").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("src", "bucket", "part").orderBy("id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases.drop("n"), ["src", "bucket", "part"])
    placed = placed.withColumn("begin", F.col("base") + F.col("local")).drop("base", "local", "bucket", "part", "tie")
    return scratch.keep(placed, "placed")


def plan_sources(totals: DataFrame, scratch: Scratch, weights: tuple[float, ...], block: int, most_repeats: int) -> DataFrame:
    """(of, src, source_size, target, block, blocks, slots) of sources (source, size), however many there are.

    Sources are numbered by partitions of their order. Targets come from one rate of words for each weight, that rises until
    no further source reaches its limit. slots counts the blocks to take: full rounds, and of one more round as many as come
    nearest to what is left; what rounding leaves is carried on to the next source of the same block length, so that it does
    not add up over sources.
    """
    spark = totals.sparkSession
    ordered = scratch.keep(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    first, firsts = 0, []
    for row in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        firsts.append((row["part"], first))
        first += row["n"]
    src = F.col("first") + F.col("at").bitwiseAND(F.lit(2**33 - 1))
    # A row for each partition of the table of sources.
    numbered = ordered.withColumn("part", part).join(F.broadcast(spark.createDataFrame(firsts, "part long, first long")), "part").withColumn("src", src)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights)).cast("int"))
    weighed = scratch.keep(numbered.select("source", "src", F.col("size").alias("source_size"), weight.alias("weight")), "weighed")
    limit = F.col("source_size") * float(most_repeats)
    total, rate = float(weighed.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        open_one = (F.col("source_size") > 0) & (F.col("weight") * rate <= limit)
        sums = weighed.agg(F.sum(F.when(open_one, F.col("weight")).otherwise(0.0)), F.sum(F.when(open_one, F.lit(0.0)).otherwise(limit))).first()
        higher = (total - sums[1]) / sums[0] if sums[0] else rate
        if higher <= rate:
            break
        rate = higher
    planned = weighed.withColumn("target", F.least(limit, F.col("weight") * rate))
    planned = planned.withColumn("block", F.least(F.lit(block), F.greatest(F.lit(1), F.expr(f"source_size div {BLOCKS_OF_A_SOURCE}"))).cast("int"))
    planned = planned.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_repeats))).otherwise(F.lit(0))
    planned = planned.withColumn("full", full).withColumn("rest", (F.col("target") - F.col("full") * F.col("source_size")) / F.col("block"))
    planned = planned.withColumn("group", F.expr(f"src div {SOURCES_OF_A_GROUP}"))
    # Sums of what is left, over groups and then inside each.
    before = Window.partitionBy("block").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = planned.groupBy("block", "group").agg(F.sum("rest").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0.0))).drop("n")
    inside = Window.partitionBy("block", "group").orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    upto = planned.withColumn("upto", F.sum("rest").over(inside)).join(bases, ["block", "group"]).withColumn("upto", F.col("base") + F.col("upto"))
    more = F.round(F.col("upto")) - F.round(F.col("upto") - F.col("rest"))
    more = F.when(F.col("full") < most_repeats, F.least(F.greatest(more, F.lit(0.0)), F.col("blocks"))).otherwise(F.lit(0))
    slots = F.col("full") * F.col("blocks") + more
    return scratch.keep(upto.select(F.col("source").alias("of"), "src", "source_size", "target", "block", "blocks", slots.cast("long").alias("slots")), "plan")


def draws_of(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(shard, source, first, n) of shard_counts: the numbers first .. first + n - 1 of a source's slots fall to a shard."""
    firsts = np.cumsum(counts, axis=0) - counts
    at, src = np.nonzero(counts)
    return at, src, firsts[at, src], counts[at, src]


def draws_of_shards(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """Multinomial draws in two steps, which together are one: each shard's slots of each group, then those of its sources."""
    grouped = sources.select("src", "slots", F.expr(f"src div {SOURCES_OF_A_GROUP}").alias("group"))
    quotas = grouped.groupBy("group").agg(F.sum("slots").alias("n")).orderBy("group").collect()
    at, group, _, n = draws_of(shard_counts(np.array([r["n"] for r in quotas], dtype=np.int64), shard, seed))
    shares = sources.sparkSession.createDataFrame(list(zip(group.tolist(), at.tolist(), n.tolist(), strict=True)), "group long, shard int, n long")

    def split(key: tuple, own: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        own, shares = own.sort_values("src"), shares.sort_values("shard")
        at, src, first, n = draws_of(shard_counts(own["slots"].to_numpy(), shares["n"].tolist(), seed + 1 + int(key[0])))
        return pd.DataFrame({"shard": shares["shard"].to_numpy()[at], "src": own["src"].to_numpy()[src], "first": first, "n": n})

    return grouped.groupBy("group").cogroup(shares.groupBy("group")).applyInPandas(split, "shard int, src long, first long, n long")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    block: int = 32,
    most_repeats: int = 3,
    seed: int = 1234567,
    bucket_rows: int = 5_000,
    keep_text: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, takes): the rows of docs with id, src, source_size, target, size and begin; and what the mix takes of them.
    With keep_text the rows hold all columns of docs in `doc`, and src, size, block and begin besides.

    The words of a source, in the order of its documents, are cut into blocks of `block` words, or of fewer if the source is
    small. Output shards draw how many blocks they hold of each source, multinomially by what the sources' targets still
    leave; the blocks of a source are numbered through all shards, and each number stands for a place in a pseudorandom
    permutation of the source's blocks, a new permutation for each round over them. Numbers and documents meet by a join on
    source and block.

    takes: src, begin (together a row's key), round, index, shard, taken. Sources, by code point with null last, weigh as
    `weights` repeat and share all words; a target stops at most_repeats times its source's size, and the excess goes to the
    others by weight. A source's taken words differ from its target by less than two of its blocks.

    Offsets of documents are summed within buckets of rows and then over buckets, so a source that holds most of all rows is
    no single task; sources are planned by Spark, so there may be as many as there are rows. Null text: size 0. Null source:
    a source of its own. Null ids are ids like any other. Repeated rows: each is a document. Empty table: empty results.
    Columns of docs may have any name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = measured(docs, scratch, text_col, source_col, id_col, keep_text)
    sources = plan_sources(rows.groupBy("source").agg(F.sum("size").alias("size")), scratch, weights, block, most_repeats)
    n_sources, n_slots = sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    placed = places(rows, sources, scratch, bucket_rows)

    most_shards = max(16, min(10_000, 1_000_000 // max(1, n_sources)))
    draws = draws_of_shards(sources, max(4096, -(-n_slots // most_shards)), seed)
    draws = draws.repartition(max(spark.sparkContext.defaultParallelism, n_slots // 100_000))
    runs = draws.select("shard", "src", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(1024).cast("long"))).alias("low"), (F.col("first") + F.col("n")).alias("end"))
    slots = runs.select("shard", "src", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + 1023, F.col("end") - 1))).alias("slot"))
    slots = slots.join(sources.select("src", "blocks"), "src").withColumn("round", F.expr("slot div blocks"))
    spot = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "src", "round"))
    slots = slots.select("shard", "src", "round", spot.alias("index"))

    indexes = F.sequence(F.expr("begin div block"), F.expr("(begin + size - 1) div block"))
    pieces = placed.where("size > 0").select("src", "begin", "size", "block", F.explode(indexes).alias("index"))
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("index") + 1) * F.col("block")) - F.greatest("begin", F.col("index") * F.col("block"))
    takes = pieces.join(slots, ["src", "index"]).select("src", "begin", "round", "index", "shard", overlap.alias("taken"))
    if keep_text:
        placed = rows.select("row", "doc").join(placed.select("row", "src", "size", "block", "begin"), "row")
    return placed, takes


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target and taken (words that the mix takes of it, repeats counted)."""
    rows, takes = mix(docs, **options)
    taken = takes.groupBy("src", "begin").agg(F.sum("taken").alias("taken"))
    # Documents without words share a place with the next one and have none of its words.
    found = rows.join(taken, ["src", "begin"], "left")
    words = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return found.select(F.col("id").alias(options.get("id_col", "doc_id")), "size", "source_size", "target", words.alias("taken"))


def mix_documents(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: for each round that takes words of a document, a row of docs with those words as its text.

    A round that takes all of a document gives its text unchanged; otherwise the words of its taken blocks, in order, are
    joined by spaces; a column n_chars is counted anew. Documents that the mix takes nothing of, or that have no words, are
    not in the result.
    """
    rows, takes = mix(docs, text_col=text_col, keep_text=True, **options)
    of_round = takes.groupBy("src", "begin", "round").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list("index")).alias("indexes"))
    joined = rows.where("size > 0").join(of_round, ["src", "begin"])
    old = F.col("doc").getField(text_col)

    def cut(words: Column) -> Column:
        def one(index: Column) -> Column:
            low = F.greatest(F.col("begin"), index * F.col("block"))
            high = F.least(F.col("begin") + F.col("size"), (index + 1) * F.col("block"))
            return F.slice(words, (low - F.col("begin") + 1).cast("int"), (high - low).cast("int"))

        return F.array_join(F.flatten(F.transform("indexes", one)), " ")

    text = F.when(F.col("taken") == F.col("size"), old).otherwise(bind(split_words(old), cut))
    fresh = {"n_chars": F.length(text).cast("bigint"), text_col: text}
    return joined.select(*(fresh.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
