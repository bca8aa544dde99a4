"""Profiles of entities, quality reports, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Price of a million prompt and completion tokens where a model has none of its own.
DEFAULT_PRICE = (1.0, 5.0)


def field_statistics(cells: DataFrame, total: int, samples: int = 5) -> DataFrame:
    """For cells (entity, ord, field, value, number): fill_rate, unique_count, low, high (of numbers) and first samples of each field."""
    stats = cells.groupBy("field").agg(
        (F.count("value") / F.lit(max(total, 1))).alias("fill_rate"),
        F.count_distinct("value").alias("unique_count"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
    )
    seen = cells.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.min("ord").alias("ord"))
    few = seen.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("ord"))).where(F.col("n") <= samples)
    lists = few.groupBy("field").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda s: s["value"]).alias("samples"))
    return stats.join(lists, "field", "left")


def data_dictionary(fields: DataFrame, statistics: DataFrame, sampled: bool) -> DataFrame:
    """Schema fields (name, type, required, description) with their statistics."""
    return fields.join(statistics.withColumnRenamed("field", "name"), "name", "left").withColumn("sampled", F.lit(sampled))


def quality_report(entities: DataFrame, by: list[str] | None = None, score: str = "quality") -> DataFrame:
    """Count, average (0 if there is none, to two places) and counts of four ranges; a null score is poor."""
    q = F.coalesce(F.col(score), F.lit(0.0))
    return entities.groupBy(*(by or [])).agg(
        F.count("*").alias("entity_count"),
        F.round(F.coalesce(F.avg(score), F.lit(0.0)), 2).alias("average_quality"),
        F.count_if(q >= 0.9).alias("excellent"),
        F.count_if((q >= 0.7) & (q < 0.9)).alias("good"),
        F.count_if((q >= 0.5) & (q < 0.7)).alias("fair"),
        F.count_if(q < 0.5).alias("poor"),
    )


def field_completeness(records: DataFrame, fields: list[str]) -> DataFrame:
    """For each column the share of rows with a value that is not empty, to two places."""
    counts = records.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields])
    rows = counts.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])).alias("x"))
    return rows.select("x.field", F.when(F.col("n") > 0, F.round(F.col("x.filled") / F.col("n"), 2)).otherwise(0.0).alias("completeness"))


def usage_rollup(usage: DataFrame, groups: list[str]) -> DataFrame:
    """Tokens, cost and calls, in all and by each of the groups, in one pass: kind says which group a key belongs to."""
    keys = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")), *[F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("key")) for g in groups])
    rows = usage.withColumn("__key", F.explode(keys)).where(F.col("__key.key").isNotNull())
    return rows.groupBy(F.col("__key.kind").alias("kind"), F.col("__key.key").alias("key")).agg(
        F.sum("total_tokens").alias("tokens"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).alias("cost"), F.count("*").alias("calls")
    )


def top_jobs(usage: DataFrame, n: int = 50) -> DataFrame:
    """The n costliest jobs; of equal ones the smaller id."""
    by = usage.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.sum("total_tokens").alias("tokens"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).alias("cost"))
    return by.orderBy(F.desc("cost"), "job_id").limit(n)


def since_days(df: DataFrame, column: str, days: int, now: Column) -> DataFrame:
    if not 1 <= days <= 365:
        raise ValueError("1 to 365 days")
    return df.where(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def estimate_cost(jobs: DataFrame, prices: DataFrame, averages: DataFrame) -> DataFrame:
    """Cost of jobs (job_id, seeds, max_depth, max_pages, batch, model) by purpose: job_id, purpose, calls, tokens, cost_usd.

    Pages: the seeds; twenty times as many at depth 1; all allowed beyond. averages (purpose, prompt_tokens,
    completion_tokens) has the usual call; prices (model, prompt, completion) are dollars a million tokens. Models
    without a maker in their name run at home and are free.
    """
    pages = F.when(F.col("max_depth") == 0, F.least("seeds", "max_pages")).when(F.col("max_depth") == 1, F.least(20 * F.col("seeds"), F.col("max_pages"))).otherwise(F.col("max_pages"))
    rows = jobs.withColumn("pages", pages.cast("long")).join(prices, "model", "left").join(F.broadcast(averages.limit(100)))
    per_page = F.when(F.col("purpose") == "pageRelevance", 1.0).when(F.col("purpose") == "extraction", 0.7).when(F.col("purpose") == "linkEvaluation", 0.05)
    calls = F.when(per_page.isNotNull(), F.ceil(F.round(F.col("pages") * per_page, 9))).when(F.col("purpose") == "schemaEvolution", F.ceil(F.col("pages") / F.col("batch"))).otherwise(F.lit(1))
    rows = rows.withColumn("calls", calls.cast("long"))
    home = ~F.contains(F.col("model"), F.lit("/"))
    price = lambda column, default: F.when(home, F.lit(0.0)).otherwise(F.coalesce(column, F.lit(default)))
    cost = (F.col("prompt_tokens") * price("prompt", DEFAULT_PRICE[0]) + F.col("completion_tokens") * price("completion", DEFAULT_PRICE[1])) * F.col("calls") / 1e6
    return rows.select("job_id", "pages", "purpose", "calls", (F.col("calls") * (F.col("prompt_tokens") + F.col("completion_tokens"))).alias("tokens"), F.round(cost, 3).alias("cost_usd"))


def status_counts(rows: DataFrame, by: str, column: str, statuses: list[str]) -> DataFrame:
    """A column of counts for each status, 0 where there is none."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(column) == s).alias(s) for s in statuses])


def job_status(tasks: DataFrame, entities: DataFrame, actions: DataFrame) -> DataFrame:
    """For each job: tasks that ended, entities and actions that wait."""
    done = tasks.groupBy("job_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status").isin("completed", "failed", "skipped")).alias("ended"))
    made = entities.groupBy("job_id").agg(F.count("*").alias("entities"))
    wait = actions.where("status = 'pending'").groupBy("job_id").agg(F.count("*").alias("pending_actions"))
    return done.join(made, "job_id", "left").join(wait, "job_id", "left").na.fill(0)


def health(tasks: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """One row: tasks (key, status) without a job, failed ones and pending ones."""
    known = jobs.select(key).distinct().withColumn("known", F.lit(True))
    return tasks.join(known, key, "left").agg(
        F.count_if(F.col("known").isNull()).alias("orphaned"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending")
    )
