"""Reading pages, logs, contents, projects and tables kept elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.evolve import Field

STATUS_SHAPE = "level string, time timestamp, message string, context map<string, string>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages kept as Parquet."""
    return spark.read.parquet(path)


def contents(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """Stored contents by key (the file's path below the folder): texts, or bytes. Any store that Hadoop reads will do."""
    if binary:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("body"))
    else:
        raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    key = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^.*" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return raw.select(key.alias("key"), "body")


def log_lines(spark: SparkSession, path: str, level: str | None = None) -> DataFrame:
    """JSON lines of a log, of one level or all; lines that don't parse are left out."""
    rows = spark.read.schema(STATUS_SHAPE).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("level") == level) if level else rows


def database(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A table of a database, read in ranges of its key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def pulled_since(remote: DataFrame, local: DataFrame, time_col: str, id_col: str) -> DataFrame:
    """What a remote table has beyond the last pull: rows changed since the local table's latest, or new ones at that time."""
    mark = local.agg(F.max(time_col).alias("__mark"))
    fresh = remote.join(F.broadcast(mark))  # one row
    fresh = fresh.where(F.col("__mark").isNull() | (F.col(time_col) >= F.col("__mark"))).drop("__mark")
    return fresh.join(local.select(id_col, time_col), [id_col, time_col], "left_anti").select(remote.columns)


@dataclass(frozen=True)
class Project:
    name: str
    seeds: tuple[str, ...]
    fields: tuple[Field, ...] = ()
    mode: str = "discovery"
    max_depth: int = 2
    max_pages: int = 100
    options: dict = field(default_factory=dict)


def read_field(name: str, spec: str | dict) -> Field:
    """A field from its short form, a type, or its long one."""
    if isinstance(spec, str):
        return Field(name, spec)
    item = read_field("item", spec["item"]) if "item" in spec else None
    inner = tuple(read_field(k, v) for k, v in spec.get("fields", {}).items())
    return Field(name, spec.get("type", "string"), bool(spec.get("required", False)), spec.get("description", ""), tuple(spec.get("enum", ())), item, inner, spec.get("normalization"))


def project(text: str) -> Project:
    """A project from YAML. Unknown names at the top are errors; without a mode, given fields make it hybrid."""
    import yaml

    data = yaml.safe_load(text) or {}
    known = {"name", "seeds", "fields", "mode", "crawl", "llm", "reconciliation", "export"}
    if odd := set(data) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
    if not data.get("name") or not data.get("seeds"):
        raise ValueError("a project has a name and seeds")
    fields = tuple(read_field(k, v) for k, v in (data.get("fields") or {}).items())
    crawl = data.get("crawl") or {}
    rest = {k: data[k] for k in ("llm", "reconciliation", "export") if k in data}
    return Project(data["name"], tuple(data["seeds"]), fields, data.get("mode") or ("hybrid" if fields else "discovery"), crawl.get("max_depth", 2), crawl.get("max_pages", 100), rest)
