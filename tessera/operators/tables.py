"""Relational operators of the record store: searches, pages of rows, joins, upserts, retention and deletion."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.operators.scans import RANGE_ROWS, Running, in_ranges, with_running
from tessera.plans.scratch import Scratch

# Days that rows of each kind are kept.
RETENTION = {"completed_jobs": 90, "failed_jobs": 30, "pages": 30, "exports": 30, "audit_log": 365, "llm_usage": 365, "dead_letters": 90}


def matching(df: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns equal the values; None asks for null and a list for any of its members."""
    for name, value in equal.items():
        c = F.col(name)
        df = df.where(c.isNull() if value is None else c.isin(*value) if isinstance(value, (list, tuple, set)) else c == value)
    return df


def least_quality(df: DataFrame, column: str, least: float, missing: float | None = None) -> DataFrame:
    """Rows of that quality at least; rows without one count as `missing`, or not at all."""
    quality = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    return df.where(quality >= least)


def from_source(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows of local runs (no source, or `local`) or of remote ones (`remote:` and a name)."""
    source = F.col(column)
    return df.where(source.isNull() | (source == "local") if kind == "local" else source.startswith("remote:"))


def flagged(df: DataFrame, hit: Column, reason: str) -> DataFrame:
    """Rows with the reason to extract them again, null where there is none."""
    return df.withColumn("reason", F.when(hit, F.lit(reason)))


def over_quota(tasks: DataFrame, quotas: DataFrame) -> DataFrame:
    """Whether jobs have completed as many tasks (job_id, status) as their quota (job_id, quota); never without a quota."""
    done = tasks.groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("completed"))
    return done.join(quotas, "job_id", "left").withColumn("over", F.coalesce(F.col("completed") >= F.col("quota"), F.lit(False)))


def record_text(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def search_like(df: DataFrame, query: str, text: Column) -> DataFrame:
    """Rows whose text holds the query in any case; % and _ are wild."""
    return df.where(text.ilike(f"%{query}%"))


def search_plain(df: DataFrame, query: str, text: Column) -> DataFrame:
    """The same without wild cards."""
    return df.where(F.contains(F.lower(text), F.lower(F.lit(query))))


def search_values(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows of which any value holds the query in any case."""
    values = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    return df.where(F.exists(values, lambda v: F.contains(v, F.lower(F.lit(query)))))


def offset_page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, n: int, descending: bool = False) -> DataFrame:
    """The next n rows behind a key in the order of the keys."""
    place = F.struct(*keys)
    if after is not None:
        bound = F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)])
        df = df.where(place < bound if descending else place > bound)
    return df.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys]).limit(n)


def next_cursor(rows: list[Row], keys: list[str], n: int) -> str | None:
    """A cursor behind the last row, if the page is full."""
    if len(rows) < n or not rows:
        return None
    return base64.urlsafe_b64encode(json.dumps([str(rows[-1][k]) for k in keys]).encode()).decode()


def read_cursor(text: str) -> list[str]:
    return json.loads(base64.urlsafe_b64decode(text))


def pages_of(df: DataFrame, key: str, n: int = 500) -> Iterator[list[Row]]:
    """All rows in the order of the key, n at a time, as they are read."""
    page: list[Row] = []
    for row in df.orderBy(key).toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == n:
            yield page
            page = []
    if page:
        yield page


def page_bounds(df: DataFrame, keys: list[str], n: int = 500, range_rows: int = RANGE_ROWS) -> DataFrame:
    """page (from 0), rows, and the first and last keys of all pages of n rows in the order of the keys, in one job.

    Rows are numbered inside ranges of the order and then over the ranges. Readers take pages by keyset_page from the bounds,
    any of them and side by side, where `pages_of` hands on one after the other. keys have to tell rows apart.
    """
    ranged = in_ranges(df.select(*keys), Scratch(df.sparkSession, "pages"), [], keys, "ranges", range_rows)
    numbered = with_running(ranged, [], keys, {"__row": Running("sum", F.lit(1))})
    page = F.floor((F.col("__row") - 1) / n).cast("long").alias("page")
    return numbered.groupBy(page).agg(F.count("*").alias("rows"), F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"))


def with_counts(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """left with the number of rows of right for its key, 0 where there is none."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def orphans(rows: DataFrame, key: str, users: list[DataFrame]) -> DataFrame:
    """Rows that none of the users (one column of keys each) refers to; null keys in users refer to nothing."""
    used = users[0].toDF(key)
    for more in users[1:]:
        used = used.union(more.toDF(key))
    return rows.join(used, key, "left_anti")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """table with the batch's last row (by seq) of each key in place of, or besides, its own."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(seq))
    new = batch.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", seq)
    return table.join(new, keys, "left_anti").unionByName(new.select(table.columns))


def upsert_counts(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """inserted and updated: a key's first row of the batch inserts if the table lacks it; all others update."""
    per_key = batch.groupBy(*keys).agg(F.count("*").alias("n")).join(table.select(*keys, F.lit(True).alias("had")), keys, "left")
    inserted = F.coalesce(F.sum(F.when(F.col("had").isNull(), 1).otherwise(0)), F.lit(0))
    return per_key.agg(inserted.alias("inserted"), (F.coalesce(F.sum("n"), F.lit(0)) - inserted).alias("updated"))


def expired(df: DataFrame, kind: str, column: str, now: Column, days: DataFrame | None = None) -> DataFrame:
    """Rows older than their kind is kept; days (tenant_id, days) overrides single tenants."""
    keep = F.lit(RETENTION[kind])
    if days is not None:
        df = df.join(days, "tenant_id", "left")
        keep = F.coalesce("days", keep)
    out = df.where(F.col(column) < now - F.make_dt_interval(keep.cast("int")))
    return out.drop("days") if days is not None else out


def delete_where_in(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """What a delete of the rows with those keys leaves."""
    return df.join(gone.select(key), key, "left_anti")


def cascade(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str, str]], root: str, gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """What remains of all tables once rows of root go: parents names, for a table, its parent and the two key columns.

    Tables are given parents first.
    """
    lost = {root: tables[root].join(gone.select(key), key, "left_semi")}
    left = {root: delete_where_in(tables[root], key, gone)}
    for name, (parent, own, of_parent) in parents.items():
        keys = lost[parent].select(F.col(of_parent).alias(own)).distinct()
        lost[name] = tables[name].join(keys, own, "left_semi")
        left[name] = tables[name].join(keys, own, "left_anti")
    return left


def redacted_log(log: DataFrame, tenant: str, columns: list[str]) -> DataFrame:
    """The audit log with a tenant's personal columns blanked."""
    own = F.col("tenant_id") == tenant
    return log.withColumns({c: F.when(own, F.lit("[REDACTED]")).otherwise(F.col(c)) for c in columns})


def requeue(tasks: DataFrame, statuses: list[str]) -> DataFrame:
    """Tasks of those statuses waiting anew, without attempts and errors."""
    hit = F.col("status").isin(*statuses)
    return tasks.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "error_message": F.when(~hit, F.col("error_message"))})


def changed_since(df: DataFrame, column: str, mark: Column) -> DataFrame:
    return df.where(F.col(column) > mark)


def check_transitions(events: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Job events (job_id, seq, status) with whether each follows from the one before."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("seq"))
    pairs = [f"{a}>{b}" for a, b in allowed]
    step = F.concat(before, F.lit(">"), F.col("status"))
    return events.withColumn("previous", before).withColumn("valid", F.col("previous").isNull() | step.isin(*pairs))
