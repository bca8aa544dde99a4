"""robots.txt: its rules as a table, and the URLs that they let through."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import host

RULES = "host string, pattern string, allow boolean"
PARSED = "host string, rules array<struct<pattern: string, allow: boolean>>, delay_ms long"


def groups_of(text: str) -> list[tuple[set[str], list[tuple[str, bool]], float | None]]:
    """The groups of a robots.txt: agents, (pattern, allow) rules and the delay in seconds."""
    groups: list[tuple[set[str], list, list]] = []
    open_group = False
    for line in text.lstrip("\ufeff").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            # Agents that follow each other share a group.
            if not open_group:
                groups.append((set(), [], []))
            groups[-1][0].add(value.lower().split("/")[0].strip())
            open_group = True
        elif groups:
            open_group = False
            if name in ("allow", "disallow") and value:
                groups[-1][1].append((value, name == "allow"))
            elif name == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                groups[-1][2].append(float(value))
    return [(agents, rules, delays[0] if delays else None) for agents, rules, delays in groups]


def rules_for(text: str, agent: str) -> tuple[list[tuple[str, bool]], float | None]:
    """Rules and delay of all groups that name the agent, or else of those for any."""
    groups = groups_of(text)
    for name in (agent.lower().split("/")[0].strip(), "*"):
        own = [g for g in groups if name in g[0]]
        if own:
            return [r for _, rules, _ in own for r in rules], next((d for _, _, d in own if d is not None), None)
    return [], None


def parse_robots(files: DataFrame, agent: str) -> DataFrame:
    """host, rules (pattern, allow) and delay_ms for an agent, of files (host, body). A null or odd body has no rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pattern", pa.string()), ("allow", pa.bool_())]))
        for batch in batches:
            read = [rules_for(body or "", agent) for body in batch.column("body").to_pylist()]
            rules = [[{"pattern": p, "allow": a} for p, a in own] for own, _ in read]
            delays = [None if d is None else int(d * 1000) for _, d in read]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rules, kind), pa.array(delays, pa.int64())], names=["host", "rules", "delay_ms"])

    return files.select(F.lower("host").alias("host"), "body").mapInArrow(run, PARSED)


def rule_rows(parsed: DataFrame) -> DataFrame:
    """host, pattern and allow of each rule."""
    return parsed.select("host", F.explode("rules").alias("r")).select("host", "r.pattern", "r.allow")


def crawl_delays(parsed: DataFrame) -> DataFrame:
    """host and delay_ms, as `admission.polite_grants` takes them."""
    return parsed.where("delay_ms IS NOT NULL").select("host", "delay_ms")


def as_regex(pattern: Column) -> Column:
    """A pattern with * for any characters and $ at its end as a regular expression."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.expr("left(pattern, length(pattern) - 1)")).otherwise(pattern)
    quoted = F.transform(F.split(body, r"\*"), lambda part: F.concat(F.lit(r"\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit("(?s)^"), F.array_join(quoted, ".*"), F.when(ends, F.lit("$")).otherwise(F.lit("")))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) that rules (host, pattern, allow) let through: the longest matching pattern decides, allow on ties or none.

    A pattern begins with some plain characters, up to a * or an end sign. A URL offers the beginnings of its path, but only
    of lengths that its host's rules have, and meets rules by host and beginning; patterns with signs are then tried. So a
    host of very many rules costs a URL no more than its path's length.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    keyed = urls.select("url", host("url").alias("host"), F.when(~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path).alias("path")).distinct()
    lead = F.regexp_extract("pattern", r"^([^*]*?)(?:\*.*|\$)?$", 1)
    told = rules.where("pattern <> ''").select("host", "pattern", "allow").distinct().withColumn("lead", lead).withColumn("regex", F.when(F.col("pattern").contains("*") | F.col("pattern").endswith("$"), as_regex(F.col("pattern"))))
    # No longer than the longest path.
    lengths = told.groupBy("host").agg(F.collect_set(F.length("lead")).alias("lengths"))
    offered = keyed.join(lengths, "host").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("lead", F.expr("left(path, n)"))
    met = offered.join(told, ["host", "lead"]).where(F.col("regex").isNull() | F.rlike(F.col("path"), F.col("regex")))
    shut = met.groupBy("url").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("allowed")).where("NOT allowed")
    return urls.join(shut, "url", "left_anti")
