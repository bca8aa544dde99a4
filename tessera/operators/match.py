"""Which records describe one entity: by exact keys, by a share of equal keys, by alike keys; each closed transitively."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import key_text, similarity
from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch


def match_exact(records: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """records with `entity`, the smallest id of all that have the same keys. A null in any key: an entity of its own.

    Without keys all records are one entity, as an empty key is the same for all. Keys meet as hashes, not as long texts.
    """
    if not keys:
        low = records.agg(F.min(id_col).alias("entity"))
        return records.join(F.broadcast(low))  # one row
    parts = [F.concat(F.length(key_text(k)).cast("string"), F.lit(":"), key_text(k)) for k in keys]
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    key = F.when(missing, F.concat(F.lit("#"), F.col(id_col).cast("string"))).otherwise(F.sha2(F.concat_ws("|", *parts), 256))
    keyed = records.withColumn("__key", key)
    groups = keyed.groupBy("__key").agg(F.min(id_col).alias("entity"))
    return keyed.join(groups, "__key").drop("__key")


def key_classes(records: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """One row for each tuple of normalized keys that is not all empty: its smallest id and the keys k0, k1 ..."""
    named = [key_text(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = records.select(F.col(id_col).alias("id"), *named)
    some = reduce(lambda a, b: a | b, [F.col(f"k{i}") != "" for i in range(len(keys))])
    return rows.where(some).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.min("id").alias("id"))


def closed(records: DataFrame, id_col: str, keys: list[str], classes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    labels = connected_components(links, scratch, "entities")
    entity = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("entity", F.coalesce("component", "id")).drop("component", "id")
    same = [key_text(k).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    keyed = records.select("*", *same)
    return keyed.join(entity, names, "left").withColumn("entity", F.coalesce("entity", F.col(id_col))).drop(*names)


def sides(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns])


def match_composite(records: DataFrame, id_col: str, keys: list[str], threshold: float = 0.85) -> DataFrame:
    """records with `entity`: linked where equal keys / comparable keys reach the threshold (above 0); then closed.

    A key is comparable if either side has it, so a link needs at least threshold * n equal keys for either side's n keys
    that are not empty. Each row offers the sets of its keys that are large enough. Rows with equal values of a set and the
    same keys filled are all linked, so each is tied to the smallest id of them only; of rows with different keys filled,
    those smallest ids are tied where the set is large enough for both together. A pair that needs a larger set meets in
    that one. So no entity is lost, and the ties grow with the rows however many share their keys.
    """
    scratch = Scratch(records.sparkSession, "composite")
    if not keys:
        return records.withColumn("entity", F.col(id_col))
    if len(keys) > 12:
        raise ValueError("at most 12 keys")
    classes = scratch.keep(key_classes(records, id_col, keys), "classes")
    names = [f"k{i}" for i in range(len(keys))]
    filled = sum(F.when(F.col(k) != "", F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(names))

    def large_enough(mask: Column) -> Column:
        return (mask.bitwiseAND(F.col("filled")) == mask) & (F.bit_count(mask) >= F.ceil(F.lit(threshold - 1e-9) * F.bit_count("filled")))

    def held(mask: Column) -> Column:
        return F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.col(k)).otherwise(F.lit("")) for i, k in enumerate(names)])

    sets = F.filter(F.sequence(F.lit(1), F.lit((1 << len(keys)) - 1)), large_enough)
    offered = classes.withColumn("filled", filled).withColumn("mask", F.explode(sets)).withColumn("held", held(F.col("mask"))).select("id", "mask", "held", "filled")
    hubs = offered.groupBy("mask", "held", "filled").agg(F.min("id").alias("hub"))

    def enough(filled: Column) -> Column:
        return F.bit_count("mask") >= F.lit(float(threshold)) * F.bit_count(filled)

    spokes = offered.join(hubs, ["mask", "held", "filled"]).where((F.col("id") != F.col("hub")) & enough(F.col("filled")))
    other = hubs.select("mask", "held", F.col("filled").alias("filled_b"), F.col("hub").alias("hub_b"))
    between = hubs.join(other, ["mask", "held"]).where((F.col("filled") < F.col("filled_b")) & enough(F.col("filled").bitwiseOR(F.col("filled_b"))))
    links = spokes.select(F.col("hub").alias("a"), F.col("id").alias("b")).union(between.select(F.least("hub", "hub_b").alias("a"), F.greatest("hub", "hub_b").alias("b"))).distinct()
    return closed(records, id_col, keys, classes, scratch.keep(links, "links"), scratch)


def alike_texts(texts: DataFrame, least: float, scratch: Scratch, name: str) -> DataFrame:
    """(x, y, score), both ways and each with itself, of the distinct texts (t) whose similarity is `least` (above 0) or more.

    Such texts lie within (1 - least) times the longer length of edits, so they share a piece when the longer is cut into one
    piece more than that. Pairs meet on such a piece, its number and the longer length. A piece need only be looked for
    where the edits before it are no more than the pieces before it, and those behind it no more than the pieces behind it
    and itself: with more on one side, a piece on the other side is shared as well. So no pair is lost.
    """
    texts = texts.withColumn("n", F.length("t"))
    # Edits that a pair with a longer text of n characters can have.
    edits = F.floor(F.lit(1 - least + 1e-9) * F.col("n")).cast("int")
    begin = lambda i, n, e: F.floor(n * i / (e + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("e")), lambda i: F.substring(F.col("t"), begin(i, F.col("n"), F.col("e")) + 1, begin(i + 1, F.col("n"), F.col("e")) - begin(i, F.col("n"), F.col("e"))))
    cut = texts.withColumn("e", edits).select(F.col("t").alias("long"), F.col("n").alias("length"), F.posexplode(parts).alias("number", "piece"))
    # Shorter (or equal) texts offer the runs that a piece of a text of each length may be.
    shapes = texts.select(F.col("n").alias("length")).distinct()
    most = F.floor(F.lit(1 - least + 1e-9) * F.col("length")).cast("int")
    fits = texts.join(shapes, (F.col("length") >= F.col("n")) & (F.col("length") - F.col("n") <= most))
    numbered = fits.select("t", "n", "length", most.alias("e"), F.explode(F.sequence(F.lit(0), most)).alias("number"))
    at = begin(F.col("number"), F.col("length"), F.col("e"))
    span = begin(F.col("number") + 1, F.col("length"), F.col("e")) - at
    behind, shorter = F.col("e") - F.col("number"), F.col("length") - F.col("n")
    low = F.greatest(F.lit(0), at - F.col("number"), at - shorter - behind)
    high = F.least(F.col("n") - span, at + F.col("number"), at - shorter + behind)
    runs = numbered.where(low <= high).select("t", "length", "number", F.explode(F.transform(F.sequence(low, high), lambda p: F.substring(F.col("t"), p + 1, span))).alias("piece")).distinct()
    met = cut.join(runs, ["length", "number", "piece"]).select(F.least("t", "long").alias("x"), F.greatest("t", "long").alias("y")).distinct()
    alike = met.where(F.col("x") != F.col("y")).withColumn("score", similarity(F.col("x"), F.col("y"))).where(F.col("score") >= least)
    both = scratch.keep(alike, name)
    itself = texts.select(F.col("t").alias("x"), F.col("t").alias("y"), F.lit(1.0).alias("score"))
    return both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "score")).union(itself)


def fuzzy_candidates(classes: DataFrame, names: list[str], threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of classes (id and the keys of `names`) among which are all whose mean similarity reaches the threshold."""
    # A little less, for rounding.
    first, second = threshold - 1e-9, 2 * threshold - 1 - 1e-9
    two = len(names) > 1 and second > 0
    alike = {}
    for k in names:
        texts = classes.where(F.col(k) != "").select(F.lower(k).alias("t")).distinct()
        alike[k] = alike_texts(texts, second if two else first, scratch, f"alike-{k}")
    lowered = classes.select("id", *[F.lower(k).alias(k) for k in names])
    pairs = []

    def links(k: str, least: float, other: str) -> DataFrame:
        return alike[k].where(F.col("score") >= least).select(F.col("x").alias(k), F.col("y").alias(other))

    for i, k in enumerate(names):
        if not two:
            met = lowered.select(F.col("id").alias("i"), k).where(F.col(k) != "").join(links(k, first, "to"), k)
            pairs.append(met.select("i", F.col("to").alias(k)).join(lowered.select(F.col("id").alias("j"), k), k).select("i", "j"))
            continue
        # Rows that have this key alone meet each other.
        empty = reduce(lambda a, b: a & b, [F.col(o) == "" for o in names if o != k])
        lone = lowered.where(empty).select("id", k)
        met = lone.select(F.col("id").alias("i"), k).join(links(k, first, "to"), k)
        pairs.append(met.select("i", F.col("to").alias(k)).join(lone.select(F.col("id").alias("j"), k), k).select("i", "j"))
        for o in names[i + 1 :]:
            own = lowered.where((F.col(k) != "") & (F.col(o) != ""))
            best = alike[k].select(F.col("x").alias(k), F.col("y").alias("to"), F.col("score").alias("score_a"))
            other = alike[o].select(F.col("x").alias(o), F.col("y").alias("to_o"), F.col("score").alias("score_b"))
            offers = own.select(F.col("id").alias("i"), k, o).join(best, k).join(other, o).where(F.greatest("score_a", "score_b") >= first)
            offers = offers.select("i", F.col("to").alias(k), F.col("to_o").alias(o))
            pairs.append(offers.join(own.select(F.col("id").alias("j"), k, o), [k, o]).select("i", "j"))
    return reduce(DataFrame.union, pairs).where("i < j").distinct().select(F.col("i").alias("a"), F.col("j").alias("b"))


def match_fuzzy(records: DataFrame, id_col: str, keys: list[str], threshold: float = 0.85) -> DataFrame:
    """records with `entity`: linked where the mean similarity of comparable keys reaches the threshold; then closed.

    A mean of m keys that reaches it needs a key whose similarity does, and if there are more, a second one of at least
    (threshold * m - 1) / (m - 1), which is least for two: 2 * threshold - 1. Values alike enough are found for each key on
    its own; then each row offers, for two keys, the pairs of values that its own are alike to, and meets rows that have just
    these two. A value that very many rows share (a brand) thus brings together only those whose second value is alike
    too. Where only one key is comparable, or the threshold is so low that a second need not be alike, one key decides who
    meets. No pair is lost; the exact mean decides.
    """
    scratch = Scratch(records.sparkSession, "fuzzy")
    if not keys:
        return records.withColumn("entity", F.col(id_col))
    classes = scratch.keep(key_classes(records, id_col, keys), "classes")
    names = [f"k{i}" for i in range(len(keys))]
    candidates = fuzzy_candidates(classes, names, threshold, scratch)
    joined = candidates.join(sides(classes, "a").withColumnRenamed("id_a", "a"), "a").join(sides(classes, "b").withColumnRenamed("id_b", "b"), "b")
    comparable = sum(((F.col(f"{n}_a") != "") | (F.col(f"{n}_b") != "")).cast("int") for n in names)
    total = sum(F.when((F.col(f"{n}_a") == "") & (F.col(f"{n}_b") == ""), F.lit(0.0)).otherwise(similarity(F.col(f"{n}_a"), F.col(f"{n}_b"))) for n in names)
    links_found = joined.where(total >= F.lit(threshold) * comparable).select("a", "b")
    return closed(records, id_col, keys, classes, scratch.keep(links_found, "links"), scratch)


def match_groups(records: DataFrame, id_col: str, groups: DataFrame) -> DataFrame:
    """records with `entity` from groups (group, seq, id) that a model proposed: an id's first group counts, unknown ids are
    dropped, and records in no group are their own entities."""
    firsts = groups.groupBy("id").agg(F.min_by("group", F.struct("seq", "group")).alias("group"))
    members = records.select(F.col(id_col).alias("id")).join(firsts, "id")
    low = members.groupBy("group").agg(F.min("id").alias("entity"))
    found = members.join(low, "group").select(F.col("id").alias(id_col), "entity")
    return records.join(found, id_col, "left").withColumn("entity", F.coalesce("entity", F.col(id_col)))
