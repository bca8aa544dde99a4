"""Exports of entities (entity, data as a map of fields to JSON texts, quality, categories, source_count).

All formats are written by Spark's tasks. Only the two database files, which one process has to write, pass through the
driver, row batch by row batch, and refuse more rows than their limit.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import csv_cell
from tessera.operators.evolve import Field, Schema

LIMIT = 50_000
SQL_TYPES = {
    "duckdb": {"number": "DOUBLE", "boolean": "BOOLEAN", "currency": "DECIMAL(19,4)"},
    "sqlite": {"number": "REAL", "boolean": "INTEGER", "currency": "REAL"},
}


def field_value(f: Field) -> Column:
    """A field's typed value; arrays and objects stay JSON text; a value of another type is null."""
    raw = F.col("data")[f.name]
    if f.type in ("array", "object"):
        return raw
    return F.try_variant_get(F.try_parse_json(raw), "$", f.spark_type().simpleString())


def typed(entities: DataFrame, schema: Schema) -> DataFrame:
    return entities.select("entity", *[field_value(f).alias(f.name) for f in schema.fields])


def json_rows(entities: DataFrame, fields: list[str] | None = None, provenance: bool = False) -> DataFrame:
    """One JSON text for each entity: data (of the listed fields), quality, categories, source count, and provenance if wanted."""
    data = F.map_filter("data", lambda k, v: k.isin(*fields)) if fields else F.col("data")
    parts = [F.transform_values(data, lambda _, v: F.try_parse_json(v)).alias("data"), F.col("quality").alias("qualityScore"), F.col("categories"), F.col("source_count").alias("sourceCount")]
    if provenance:
        parts.append(F.col("provenance"))
    return entities.select(F.to_json(F.struct(*parts)).alias("value"))


def write_json(entities: DataFrame, path: str, **options) -> None:
    json_rows(entities, **options).write.mode("overwrite").text(path)


def envelope(job: str, schema: Schema, count: int, exported_at: str, provenance: bool = False) -> str:
    """The header of a JSON export; the entities are in the files beside it."""
    fields = [{"name": f.name, "type": f.type, "required": f.required} for f in schema.fields]
    meta = {"jobId": job, "exportedAt": exported_at, "entityCount": count, "schemaVersion": schema.version, "format": "json", "includeProvenance": provenance}
    return json.dumps({"metadata": meta, "schema": fields})


def csv_rows(entities: DataFrame, schema: Schema) -> DataFrame:
    """Lines of CSV, without the header; texts lose the quotes of their JSON, lists and objects keep theirs."""
    cells = []
    for f in schema.fields:
        raw = F.col("data")[f.name]
        plain = F.try_variant_get(F.try_parse_json(raw), "$", "string")
        cells.append(csv_cell(raw if f.type in ("array", "object") else F.coalesce(plain, F.lit(""))))
    return entities.select("entity", F.array_join(F.array(*cells), ",").alias("value"))


def csv_header(schema: Schema) -> str:
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s
    return ",".join(quote(f.name) for f in schema.fields)


def write_csv(entities: DataFrame, schema: Schema, path: str) -> None:
    """Part files of lines in the order of entities; the header is a file of its own, read first by name."""
    spark = entities.sparkSession
    csv_rows(entities, schema).orderBy("entity").select("value").write.mode("overwrite").text(f"{path}/rows")
    spark.createDataFrame([(csv_header(schema),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_parquet(entities: DataFrame, schema: Schema, path: str) -> None:
    typed(entities, schema).write.mode("overwrite").parquet(path)


def bounded(entities: DataFrame, limit: int) -> DataFrame:
    """The entities, if they are no more than the limit."""
    if entities.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} entities; write Parquet instead")
    return entities


def columns_sql(schema: Schema, kind: str) -> str:
    types = SQL_TYPES[kind]
    text = "VARCHAR" if kind == "duckdb" else "TEXT"
    return ", ".join(f'"{f.name}" {types.get(f.type, text)}{" NOT NULL" if f.required else ""}' for f in schema.fields)


def batches(df: DataFrame, size: int = 500) -> Iterator[list[tuple]]:
    batch: list[tuple] = []
    for row in df.toLocalIterator():
        batch.append(tuple(row))
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def write_sqlite(entities: DataFrame, schema: Schema, path: str, limit: int = LIMIT) -> int:
    """A table `entities` in a SQLite file, in one transaction; booleans are 0 and 1. Returns the number of rows."""
    import sqlite3

    rows, n = typed(bounded(entities, limit), schema).drop("entity"), 0
    db = sqlite3.connect(path)
    with db:
        db.execute(f"CREATE TABLE entities ({columns_sql(schema, 'sqlite')})")
        for batch in batches(rows):
            db.executemany(f"INSERT INTO entities VALUES ({', '.join('?' * len(schema.fields))})", batch)
            n += len(batch)
    db.close()
    return n


def write_duckdb(entities: DataFrame, schema: Schema, path: str, limit: int = LIMIT) -> int:
    """The same in a DuckDB file."""
    import duckdb

    rows, n = typed(bounded(entities, limit), schema).drop("entity"), 0
    db = duckdb.connect(path)
    db.execute(f"CREATE TABLE entities ({columns_sql(schema, 'duckdb')})")
    for batch in batches(rows):
        db.executemany(f"INSERT INTO entities VALUES ({', '.join('?' * len(schema.fields))})", batch)
        n += len(batch)
    db.close()
    return n


def stream_json(entities: DataFrame, **options) -> Iterator[str]:
    """A JSON list, piece by piece, as rows are read."""
    yield "["
    for i, row in enumerate(json_rows(entities, **options).toLocalIterator()):
        yield ("," if i else "") + row["value"]
    yield "]"


def stream_csv(entities: DataFrame, schema: Schema) -> Iterator[str]:
    """CSV lines behind a header, as rows are read; nothing at all for no rows."""
    for i, row in enumerate(csv_rows(entities, schema).toLocalIterator()):
        if not i:
            yield csv_header(schema) + "\n"
        yield row["value"] + "\n"


def signature(secret: str, body: str) -> str:
    """HMAC-SHA256 of a webhook's body, in hexadecimal."""
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def webhook(secret: str, send: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sends each row's JSON with its signature from the tasks; a repeated batch sends again, so receivers
    tell events apart by their ids."""

    def each(rows) -> None:
        for row in rows:
            send(row["value"], signature(secret, row["value"]))

    return lambda batch, _: batch.select(F.to_json(F.struct("*")).alias("value")).foreachPartition(each)
