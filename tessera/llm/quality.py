"""Quality rules by host: failures of document rules, shrunk to an empirical beta prior, and a verdict for each host.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bind(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of so many words that the text has twice or more."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)

    def in_order(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            again = F.filter(
                pairs,
                lambda p, k: (F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)))
                | (F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))),
            )
            return bind(F.sort_array(F.transform(again, lambda p: p["i"])), covered)

        return bind(pairs, twice)

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    none = F.lit(0).cast("bigint")
    return F.when(F.size(words) > window, bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), in_order(h)).otherwise(none))).otherwise(none)


def rule_counts(text: Column, window: int = 8) -> Column:
    """A struct of the five counts of a text and its number of lines with a word; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = bind(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w, window).alias("n_repeat_words"),
        ),
    )
    of_lines = bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint")
    return F.struct(of_words.alias("words"), symbols.alias("n_symbols"), of_lines.alias("lines"))


def host_verdicts(hosts: DataFrame, max_excess: float, most_weight: float = 10_000.0) -> DataFrame:
    """Hosts (n, failed) with `host_rate`, their failure rate shrunk to a beta prior, and `host_ok`.

    The prior's mean is the rate over all documents. Its weight in documents comes from the spread of the hosts' rates beyond
    what chance alone gives hosts of their sizes (method of moments, each host weighted by its documents), between 1 and
    most_weight. A host goes if its rate lies more than max_excess of the way from the prior's mean to 1.
    """
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts")).first()
    mean = total["failed"] / total["n"] if total["n"] else 0.0
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.lit(mean), 2)).alias("v")).first()["v"]
    single = mean * (1 - mean)
    between = (spread - single * total["hosts"]) / total["n"] if total["n"] else 0.0
    weight = min(max(single / between - 1, 1.0), most_weight) if between > 0 else most_weight
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("host_rate", rate).withColumn("host_ok", F.col("host_rate") <= mean + max_excess * (1 - mean))


def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat: int = 30,
    max_symbols: int = 10,
    max_dup_lines: int = 50,
    min_word_chars: int = 3,
    max_excess: float = 0.5,
    carry: list[str] | None = None,
) -> DataFrame:
    """docs with the rule counts, `base_failed`, `host_rate` and `kept`.

    A document goes by itself (base_failed) if it has fewer than min_words words or if more than max_repeat percent of them
    lie in repeated windows of eight words. For its host it fails too if it has more than max_symbols symbols for each 100
    characters of words, if more than max_dup_lines percent of its lines equal an earlier one, or if its words have fewer
    than min_word_chars characters on average (no rule for long ones: scripts without spaces would fail it).

    A host goes, with all its documents, if its shrunk failure rate lies more than max_excess of the way from the rate of
    all documents to 1, such as 0.55 where a tenth of all documents fail. The failures of a host are summed before they are
    shuffled, and the verdicts, one row for each host, are joined back on the host; Spark splits a host that holds very
    many rows.

    carry names the input columns that the result keeps (all of them by default); the rows pass through a shared table
    once, so leave the texts out where they are not needed.

    Null text: an empty text, which fails. Null host: a host of its own. Empty table: empty result. Repeated rows: each
    counts. An input column with the name of an output is replaced; other columns may have any name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    made = {*COUNTS, "base_failed", "host_rate", "kept"}
    kept = [c for c in dict.fromkeys([*(docs.columns if carry is None else carry), host_col]) if c not in made]
    whole = F.struct(*map(quoted, kept)) if kept else F.lit(None)
    counts = docs.select(whole.alias("doc"), quoted(host_col).alias("host"), rule_counts(quoted(text_col)).alias("c"))
    counted = counts.select("doc", "host", "c.words.*", "c.n_symbols", "c.lines.*")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > max_symbols * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > max_dup_lines * F.col("n_lines")
    short = F.col("word_chars") < min_word_chars * F.col("n_words")
    rows = scratch.keep(counted.withColumn("base_failed", base).withColumn("failed", base | symbols | lines | short), "counts")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    verdicts = host_verdicts(hosts, max_excess).select(F.col("host").alias("of"), "host_rate", "host_ok")
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
    own = [F.col("doc").getField(c).alias(c) for c in kept]
    return joined.select(*own, *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))
