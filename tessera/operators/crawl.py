"""Crawl-side operators: dedup by content, gates, link admission, the frontier, budgets and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.urls import host, may_crawl, normalize_url

EXTRACTABLE = ("single_entry", "multiple_entries", "partial")
RETRYABLE = (408, 425, 429)


def content_dedup(pages: DataFrame, html_col: str, order: list[Column], tenant: list[str] | None = None) -> DataFrame:
    """The first page of each content, by hash (within a tenant).

    Pages of one hash are reduced before they are shuffled, so a content that very many pages share is no single task.
    """
    first = F.min_by(F.struct("*"), F.struct(*order)).alias("page")
    return pages.groupBy(*(tenant or []), F.sha2(F.col(html_col), 256).alias("__hash")).agg(first).select("page.*")


def http_gate(pages: DataFrame, status_col: str = "status_code") -> DataFrame:
    """`failed` for statuses from 400 on, and whether those may be tried again."""
    status = F.col(status_col)
    return pages.withColumn("failed", status >= 400).withColumn("retryable", status.isin(*RETRYABLE) | (status >= 500))


def extractable(pages: DataFrame, column: str = "classification") -> DataFrame:
    return pages.where(F.col(column).isin(*EXTRACTABLE))


def score_links(links: DataFrame, answers: DataFrame, order: list[str] | None = None) -> DataFrame:
    """links (url) with scores from answers (url, score, expected, priority): a URL's first answer by the columns of `order`
    (by its own texts, if none).

    Missing: 0.5, unknown, medium. A score of 0 counts as missing; scores stay within 0 and 1; odd words become the defaults.
    """
    told = F.struct("score", "expected", "priority")
    known = answers.groupBy("url").agg(F.min_by(told, F.struct(*(order or []), "score", "expected", "priority")).alias("a")).select("url", "a.*")
    score = F.coalesce(F.nullif(F.col("score").try_cast("double"), F.lit(0.0)), F.lit(0.5))
    expected = F.when(F.col("expected").isin(*EXTRACTABLE, "navigation", "irrelevant"), F.col("expected")).otherwise("unknown")
    priority = F.when(F.col("priority").isin("high", "medium", "low"), F.col("priority")).otherwise("medium")
    joined = links.join(known, "url", "left")
    return joined.select(*links.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), expected.alias("expected"), priority.alias("priority"))


def admit_links(links: DataFrame, max_depth: int, least: float = 0.3) -> DataFrame:
    """Links (url, depth, score) to follow: below the depth limit, scored above `least` (or unscored), and safe to crawl."""
    return links.where((F.col("depth") < max_depth) & (F.col("score").isNull() | (F.col("score") > least)) & may_crawl("url"))


def frontier(tasks: DataFrame, n: int) -> DataFrame:
    """The next n tasks: by priority, then the shallower, then the older (seq)."""
    return tasks.orderBy(F.desc("priority"), "depth", "seq").limit(n)


def within_budget(links: DataFrame, max_pages: int, counted: int, order: list[Column]) -> DataFrame:
    """As many of the links, in order, as the budget of pages still admits."""
    return links.orderBy(*order).limit(max(0, int(max_pages) - counted))


def completeness(tasks: DataFrame, by: str = "job_id") -> DataFrame:
    """Counts by status for each job; complete if nothing waits or runs; failed if all that ended failed."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = tasks.groupBy(by).agg(*[count(s) for s in ("pending", "in_progress", "completed", "failed", "skipped")])
    done = (F.col("pending") == 0) & (F.col("in_progress") == 0)
    return out.withColumn("complete", done).withColumn("all_failed", done & (F.col("failed") > 0) & (F.col("completed") == 0))


def retry_schedule(tasks: DataFrame, base_ms: int = 2000, most: int = 3) -> DataFrame:
    """When a failed task (attempts) may run again: base times 2 to the power of attempts - 1, and never after `most`."""
    wait = (F.lit(base_ms) * F.pow(2.0, F.col("attempts") - 1)).cast("long")
    return tasks.withColumn("retry", F.col("attempts") < most).withColumn("delay_ms", F.when(F.col("attempts") < most, wait))


def seed_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Seeds (url) added or removed, compared as normalized URLs and told in their own spelling."""
    keyed = lambda df: df.select("url", F.coalesce(normalize_url("url"), F.col("url")).alias("key")).groupBy("key").agg(F.min("url").alias("url"))
    now, then = keyed(current), keyed(previous)
    added = now.join(then, "key", "left_anti").select("url", F.lit("added").alias("change"))
    return added.union(then.join(now, "key", "left_anti").select("url", F.lit("removed").alias("change")))


def sort_seeds(inputs: DataFrame, seeds: DataFrame, crawled: DataFrame) -> DataFrame:
    """inputs (url, seq) as invalid, duplicate (of a seed), crawled or new; of repeats within the inputs the first stays."""
    key = F.coalesce(normalize_url("url"), F.concat(F.lit("!"), F.col("url")))
    first = Window.partitionBy("key").orderBy("seq")
    rows = inputs.withColumn("key", key).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    known = lambda df, name: df.select(normalize_url("url").alias("key")).distinct().withColumn(name, F.lit(True))
    joined = rows.join(known(seeds, "__seed"), "key", "left").join(known(crawled, "__done"), "key", "left")
    kind = F.when(~may_crawl("url"), "invalid").when(F.col("__seed"), "duplicate").when(F.col("__done"), "crawled").otherwise("new")
    return joined.select("url", "seq", kind.alias("kind"))


def compare_crawlers(a: DataFrame, b: DataFrame) -> DataFrame:
    """For pages (url, length, ms, links) by both crawlers: differences of time and length, and links of one or both."""
    x, y = (df.select("url", *[F.col(c).alias(f"{c}_{s}") for c in ("length", "ms", "links")]) for df, s in ((a, "a"), (b, "b")))
    empty = F.array().cast("array<string>")
    la, lb = F.coalesce("links_a", empty), F.coalesce("links_b", empty)
    return x.join(y, "url", "full").select(
        "url",
        (F.col("ms_b") - F.col("ms_a")).alias("ms_delta"),
        (F.col("length_b") - F.col("length_a")).alias("length_delta"),
        F.array_except(la, lb).alias("only_a"),
        F.array_except(lb, la).alias("only_b"),
        F.array_intersect(la, lb).alias("both"),
    )


def classified(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """pages (page_id) with a model's answers (page_id, answer as JSON) as classification, strategy and confidence.

    An answer that is missing, no JSON or of another kind counts as irrelevant, to be skipped, with confidence 0.
    """
    first = answers.groupBy("page_id").agg(F.min("answer").alias("__answer"))
    told = pages.join(first, "page_id", "left").withColumn("__v", F.from_json("__answer", "classification string, strategy string, confidence double"))
    known = F.coalesce(F.col("__v.classification").isin(*EXTRACTABLE, "navigation", "irrelevant"), F.lit(False))
    return told.select(
        *pages.columns,
        F.when(known, F.col("__v.classification")).otherwise("irrelevant").alias("classification"),
        F.when(known, F.coalesce("__v.strategy", F.lit("skip"))).otherwise("skip").alias("strategy"),
        F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("__v.confidence", F.lit(0.0))))).otherwise(0.0).alias("confidence"),
    )
