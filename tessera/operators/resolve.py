"""Conflicts between the values of an entity's field: strategies, provenance, merged records, trust, gaps and quality.

Values come as cells: entity, field, ord (their order), value (JSON text), and where needed source, crawled_at and raw.
Every "first" is by ord, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUST = ("low", "medium", "high", "authoritative")
STRATEGIES = ("most_common", "most_recent", "source_priority", "most_complete", "llm_resolved")


def trust_score(level: Column) -> Column:
    score = F.lit(0)
    for n, name in enumerate(TRUST):
        score = F.when(level == name, F.lit(n)).otherwise(score)
    return score


def trust_by_priority(domains: DataFrame, priority: list[str]) -> DataFrame:
    """domains (domain) with trust: the first of the list is authoritative, the second high, all others medium."""
    level = F.lit("medium")
    for n, name in reversed(list(enumerate(priority[:2]))):
        level = F.when(F.col("domain") == name, F.lit(("authoritative", "high")[n])).otherwise(level)
    return domains.withColumn("trust", level)


def resolve(cells: DataFrame, strategy: str, trust: DataFrame | None = None) -> DataFrame:
    """entity, field, value, source, had_conflict, resolution, n_values: one row for each field with a value.

    Null values do not count. Without a conflict, the first value and its source. most_common: the commonest value, of
    equals the first seen; most_recent: by crawled_at; source_priority: by trust (source, trust), or as most_common
    without any; most_complete: the longest JSON text; llm_resolved: as most_common.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    known = cells.where(F.col("value").isNotNull())
    by = ["entity", "field"]
    common = strategy in ("most_common", "llm_resolved") or (strategy == "source_priority" and trust is None)
    if common:
        # Counts of equal values first, so that a field with very many values is summed before it meets in one place.
        values = known.groupBy(*by, "value").agg(F.count("*").alias("n"), F.min_by("source", "ord").alias("source"), F.min("ord").alias("ord"))
        rank: Column = F.struct(-F.col("n"), F.col("ord"))
        size = F.sum("n")
    else:
        values = known
        if strategy == "source_priority":
            values = values.join(trust.select("source", "trust"), "source", "left")
            rank = F.struct(-trust_score(F.col("trust")), F.col("ord"))
        elif strategy == "most_recent":
            rank = F.struct(-F.coalesce(F.unix_micros(F.col("crawled_at").cast("timestamp")), F.lit(-(2**62))), F.col("ord"))
        else:
            rank = F.struct(-F.length("value"), F.col("ord"))
        size = F.count("*")
    picked = values.groupBy(*by).agg(
        F.min_by(F.struct("value", "source"), rank).alias("best"),
        F.min_by(F.struct("value", "source"), "ord").alias("first"),
        size.alias("n_values"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    conflict = F.col("low") != F.col("high")
    chosen = F.when(conflict, F.col("best")).otherwise(F.col("first"))
    resolution = F.when(conflict, F.lit(strategy))
    return picked.select(*by, chosen["value"].alias("value"), chosen["source"].alias("source"), conflict.alias("had_conflict"), resolution.alias("resolution"), "n_values")


def provenance_type(had_conflict: Column, changed: Column, n_values: Column) -> Column:
    """How a value came about; conflicts count before normalization, that before merging."""
    return F.when(had_conflict, "resolved").when(changed, "normalized").when(n_values > 1, "merged").otherwise("extracted")


def provenance(cells: DataFrame, resolved: DataFrame) -> DataFrame:
    """resolved with the type of provenance and n_sources, the number of contributing cells.

    cells has `raw` besides; a field is changed if any of its raw values differs from the normalized one. Cells are counted
    before they meet; what each source said is in provenance_sources, a row for each, however many there are.
    """
    changed = F.max((~F.col("raw").eqNullSafe(F.col("value"))).cast("int")).alias("changed")
    detail = cells.where(F.col("value").isNotNull()).groupBy("entity", "field").agg(changed, F.count("*").alias("n_sources"))
    joined = resolved.join(detail, ["entity", "field"])
    return joined.withColumn("type", provenance_type(F.col("had_conflict"), F.col("changed") == 1, F.col("n_values"))).drop("changed")


def provenance_sources(cells: DataFrame) -> DataFrame:
    """What each source contributed: entity, field, ord, source, raw and value of the cells with a value."""
    return cells.where(F.col("value").isNotNull()).select("entity", "field", "ord", "source", "raw", "value")


def gathered_sources(sources: DataFrame, most: int = 1000) -> DataFrame:
    """entity, field, n_sources and sources (source, raw, value), the first `most` by ord, for records that go out as one JSON text."""
    by = Window.partitionBy("entity", "field").orderBy("ord", "source")
    first = sources.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
    lists = first.groupBy("entity", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "source", "raw", "value"))), lambda s: s.dropFields("n")).alias("sources"))
    return sources.groupBy("entity", "field").agg(F.count("*").alias("n_sources")).join(lists, ["entity", "field"])


def merge_records(resolved: DataFrame) -> DataFrame:
    """entity and data, a map from fields to values."""
    pairs = F.sort_array(F.collect_list(F.struct("field", "value")))
    return resolved.groupBy("entity").agg(F.map_from_entries(pairs).alias("data"))


def missing_fields(entities: DataFrame, required: list[str]) -> DataFrame:
    """(entity, field) for required fields that data (a map) has no value for."""
    wanted = entities.select("entity", "data", F.explode(F.array(*[F.lit(f) for f in required]).cast("array<string>")).alias("field"))
    return wanted.where(F.coalesce(F.col("data")[F.col("field")], F.lit("null")).isin("null", '""')).select("entity", "field")


def fill_gaps(resolved: DataFrame, gaps: DataFrame, proposals: DataFrame, least: float = 0.5) -> DataFrame:
    """resolved with proposals (entity, field, value, confidence) for gaps, where they are asked for, not empty and sure enough."""
    first = proposals.where((F.col("confidence") >= least) & ~F.coalesce(F.col("value"), F.lit("null")).isin("null", '""', "[]", "{}"))
    one = first.groupBy("entity", "field").agg(F.max_by("value", F.struct("confidence", "value")).alias("value"))
    found = gaps.join(one, ["entity", "field"])
    columns = [F.col(c) if c in ("entity", "field", "value") else F.lit("inferred").alias(c) if c == "type" else F.lit(None).cast(dict(resolved.dtypes)[c]).alias(c) for c in resolved.columns]
    return resolved.unionByName(found.select(*columns))


def quality_scores(members: DataFrame, total: int) -> DataFrame:
    """entity, sources and quality: an entity's records as a share of all meaningful records of the job."""
    return members.groupBy("entity").agg(F.count("*").alias("sources")).withColumn("quality", F.col("sources") / F.lit(max(total, 1)))


def entity_label(data: Column, entity: Column) -> Column:
    return F.coalesce(data["name"], data["title"], F.concat(F.lit("Entity "), F.substring(entity.cast("string"), 1, 8)))


def enrich(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """Extractions (page_id) with the url, host and time of their pages (page_id, url, created_at); a made-up url where there is no page."""
    of_page = pages.select("page_id", F.col("url").alias("__url"), F.col("created_at").alias("crawled_at"))
    joined = extractions.join(of_page, "page_id", "left")
    url = F.coalesce("__url", F.concat(F.lit("https://unknown/"), F.col("page_id").cast("string")))
    return joined.withColumn("source_url", url).withColumn("source_domain", F.lower(F.try_parse_url(url, F.lit("HOST")))).drop("__url")


def trust_from_answers(domains: DataFrame, answers: DataFrame) -> DataFrame:
    """A model's trust levels (domain, trust) for the domains asked about; odd levels and other domains are dropped."""
    known = answers.where(F.col("trust").isin(*TRUST)).groupBy("domain").agg(F.min("trust").alias("trust"))
    return domains.join(known, "domain")


def normalize_cells(cells: DataFrame, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """cells (field, value as JSON text) with `raw`, the value before, and the value under its field's rule.

    A rule takes the text of a JSON string or number and returns a text, list or struct; other values, and null, stay.
    """
    ruled = F.col("field").isin(*rules) & F.col("value").rlike(r'^("|-?\d)')
    text = F.when(ruled, F.try_variant_get(F.try_parse_json("value"), "$", "string"))
    out = F.lit(None).cast("string")
    for name, rule in rules.items():
        out = F.when(F.col("field") == name, F.to_json(F.array(rule(F.col("__text"))))).otherwise(out)
    # Exploded, so that a filter on the value, or several uses of it, don't work it out anew.
    done = cells.withColumn("raw", F.col("value")).withColumns({"__ruled": ruled, "__text": text})
    done = done.select("*", F.explode(F.array(F.when(F.col("__ruled"), out))).alias("__json"))
    same = F.col("__json").isin(F.to_json(F.array("__text")), F.concat(F.lit('["'), "raw", F.lit('"]')))  # the last: a number as it was written
    told = F.when(F.col("__json") == "[null]", F.when(F.col("__text") == "", F.col("raw")).otherwise('""')).when(~same, F.substring("__json", F.lit(2), F.length("__json") - 2))
    return done.withColumn("value", F.coalesce(told, F.col("raw"))).drop("__ruled", "__text", "__json")


def changes(cells: DataFrame) -> DataFrame:
    """Cells whose value is not their raw one: what normalization changed."""
    return cells.where(~F.col("raw").eqNullSafe(F.col("value"))).select(*[c for c in cells.columns if c not in ("raw", "value")], F.col("raw").alias("before"), F.col("value").alias("after"))
