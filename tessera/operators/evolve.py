"""Schemas that follow the data: unmapped fields, samples, versions and their changes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import SPACE, normalize_enum

LOGICAL = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "url": T.StringType(), "currency": T.DoubleType(), "enum": T.StringType()}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    description: str = ""
    enum_values: tuple[str, ...] = ()
    item: Field | None = None
    fields: tuple[Field, ...] = ()
    rule: dict | None = None

    def spark_type(self) -> T.DataType:
        if self.type == "array":
            return T.ArrayType(self.item.spark_type() if self.item else T.StringType())
        if self.type == "object":
            return T.StructType([f.struct_field() for f in self.fields]) if self.fields else T.StringType()
        return LOGICAL.get(self.type, T.StringType())

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type(), not self.required)


@dataclass(frozen=True)
class Schema:
    version: int
    fields: tuple[Field, ...]
    parent: int | None = None
    aliases: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def place(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.fields) if f.name == name), None)


def put(fields: tuple[Field, ...], at: int, new: list[Field], drop: int = 0) -> tuple[Field, ...]:
    return (*fields[:at], *new, *fields[at + drop :])


def changed(schema: Schema, action: dict) -> Schema:
    """The schema after one action; the same object where the action does not apply."""
    kind, name, fields = action["type"], action.get("field"), schema.fields
    at = schema.place(name) if name else None
    if kind == "add_field":
        if at is not None:
            return schema
        after = schema.place(action["after"]) if action.get("after") else None
        return replace(schema, fields=put(fields, len(fields) if after is None else after + 1, [action["definition"]]))
    if kind == "merge_fields":
        # The canonical field keeps its place, or comes last; it is never an alias of itself.
        rest = tuple(f for f in fields if f.name not in action["aliases"] or f.name == name)
        kept = action.get("definition") or (fields[at] if at is not None else Field(name))
        new = tuple(kept if f.name == name else f for f in rest) if at is not None else (*rest, kept)
        return replace(schema, fields=new, aliases=(*schema.aliases, (name, tuple(action["aliases"]))))
    if kind == "group_fields":
        places = [p for s in action["sources"] if (p := schema.place(s)) is not None]
        if not places:
            return schema
        named = action.get("mapping") or {}
        inner = tuple(replace(fields[p], name=named.get(fields[p].name, fields[p].name)) for p in places)
        rest = [f for i, f in enumerate(fields) if i not in places]
        group = Field(name, "object", description=f"Grouped from: {', '.join(action['sources'])}", fields=inner)
        return replace(schema, fields=put(tuple(rest), min(min(places), len(rest)), [group]))
    if at is None:
        return schema
    if kind == "remove_field":
        return replace(schema, fields=put(fields, at, [], 1))
    if kind == "split_field":
        return replace(schema, fields=put(fields, at, list(action["targets"]), 1))
    if kind == "rename_field":
        new = replace(fields[at], name=action["to"])
    elif kind == "modify_field":
        new = replace(fields[at], **{k: v for k, v in action["changes"].items() if k in ("type", "required", "description", "enum_values")})
    elif kind == "set_normalization_rule":
        new = replace(fields[at], rule=action["rule"])
    elif kind == "update_enum_map" and (fields[at].rule or {}).get("type") == "enum":
        old = fields[at].rule
        new = replace(fields[at], rule={**old, "synonyms": {**old.get("synonyms", {}), **action["synonyms"]}})
    else:
        return schema
    return replace(schema, fields=put(fields, at, [new], 1)) if new != fields[at] else schema


def apply_actions(schema: Schema, actions: list[dict]) -> Schema:
    """All actions in order; one version more, with this one as parent, if any applied."""
    now = schema
    for action in actions:
        now = changed(now, action)
    return schema if now is schema else replace(now, version=schema.version + 1, parent=schema.version)


def project(records: DataFrame, json_col: str, schema: Schema, keep: list[str]) -> DataFrame:
    """The fields of JSON records as typed columns; a value of another type is null."""
    json = F.try_parse_json(F.col(json_col))
    typed = [F.try_variant_get(json, f"$.{f.name}", f.spark_type().simpleString()).alias(f.name) for f in schema.fields]
    return records.select(*keep, *typed)


def read_under(records: DataFrame, json_col: str, schema: Schema, keep: list[str]) -> DataFrame:
    """JSON records of any version as the schema's typed columns: a merged field takes the first value that it or one of its
    aliases has, an object takes its members from its own JSON, and enum rules hold."""
    json = F.try_parse_json(F.col(json_col))
    aliases: dict[str, list[str]] = {}
    for name, others in schema.aliases:
        aliases.setdefault(name, []).extend(o for o in others if o != name)

    def column(f: Field) -> Column:
        kind = f.spark_type()
        value = F.coalesce(*[F.try_variant_get(json, f"$.{n}", kind.simpleString()) for n in (f.name, *aliases.get(f.name, []))])
        if (f.rule or {}).get("type") == "enum":
            value = normalize_enum(value, f.rule.get("synonyms", {}))
        return value.alias(f.name)

    return records.select(*keep, *map(column, schema.fields))


def coalesce_aliases(records: DataFrame, schema: Schema) -> DataFrame:
    """Columns of merged fields filled from their aliases, which go."""
    out = records
    for name, aliases in schema.aliases:
        present = [c for c in (name, *aliases) if c in out.columns]
        if present:
            out = out.withColumn(name, F.coalesce(*present)).drop(*[a for a in aliases if a != name])
    return out


def field_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), rf"(?U){SPACE}+", "_")


def aggregate_unmapped(fields: DataFrame, total: int, samples: int = 10) -> DataFrame:
    """Of fields (extraction_id, ord, name, value, type): what was seen under each name, by lower case and underscores.

    key, occurrences (extractions), frequency (of all), observed_names, dominant_type (of equals, the first seen), and up
    to `samples` distinct values in order of appearance. Counts and firsts are aggregated before they are gathered.
    """
    rows = fields.withColumn("key", field_key(F.col("name")))
    counts = rows.groupBy("key").agg(F.count_distinct("extraction_id").alias("occurrences"))
    names = rows.groupBy("key", "name").agg(F.min("ord").alias("ord")).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias("observed_names"))
    types = rows.groupBy("key", "type").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).groupBy("key").agg(F.min_by("type", F.struct(-F.col("n"), F.col("ord"))).alias("dominant_type"))
    first = rows.where(F.col("value").isNotNull()).groupBy("key", "value").agg(F.min("ord").alias("ord"))
    few = first.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ord", "value"))).where(F.col("n") <= samples)
    values = few.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda s: s["value"]).alias("sample_values"))
    out = counts.join(names, "key").join(types, "key").join(values, "key", "left")
    return out.withColumn("frequency", F.col("occurrences") / F.lit(max(total, 1)))


def unmapped_of_records(records: DataFrame, id_col: str, json_col: str, schema: Schema) -> DataFrame:
    """(extraction_id, ord, name, value) of what JSON objects hold beyond the schema's fields."""
    known = [f.name.lower() for f in schema.fields]
    rows = records.select(F.col(id_col).alias("extraction_id"), F.col("ord").alias("of"), F.try_parse_json(json_col).alias("v"))
    pairs = rows.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer()))
    found = pairs.where(F.col("key").isNotNull() & ~F.lower("key").isin(*known))
    return found.select("extraction_id", (F.col("of") * 10_000 + F.col("pos")).alias("ord"), F.col("key").alias("name"), F.to_json("value").alias("value"))


def value_samples(cells: DataFrame, n: int = 10) -> DataFrame:
    """The first n values, not distinct, of each field (field, ord, value)."""
    by = Window.partitionBy("field").orderBy("ord")
    return cells.where(F.col("value").isNotNull()).withColumn("n", F.row_number().over(by)).where(F.col("n") <= n)


def new_candidates(aggregated: DataFrame, schema: Schema) -> DataFrame:
    """Aggregated names that the schema does not have yet."""
    return aggregated.where(~F.col("key").isin(*[f.name.lower() for f in schema.fields]))


def due_for_evolution(extractions: DataFrame, batch: int = 10) -> DataFrame:
    """(job_id, schema_version) with so many extractions at the version that the schema should be looked at."""
    latest = extractions.groupBy("job_id", "schema_version").agg(F.count("*").alias("n"))
    return latest.withColumn("due", F.col("n") >= batch)


def schema_changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Fields (name, type, required) of two schemas: local_only, remote_only, changed or unchanged."""
    a, b = local.select("name", F.struct("type", "required").alias("a")), remote.select("name", F.struct("type", "required").alias("b"))
    kind = F.when(F.col("b").isNull(), "local_only").when(F.col("a").isNull(), "remote_only").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, "name", "full").select("name", kind.alias("change"))


def describe_fields(fields: tuple[Field, ...], depth: int = 0) -> str:
    """Fields as lines for a prompt, nested ones indented."""
    lines = []
    for f in fields:
        note = "".join([" (required)" if f.required else "", f": {f.description}" if f.description else "", f" one of {', '.join(f.enum_values)}" if f.enum_values else ""])
        lines.append("  " * depth + f"- {f.name} [{f.type}{'<' + f.item.type + '>' if f.item else ''}]{note}")
        if f.fields:
            lines.append(describe_fields(f.fields, depth + 1))
    return "\n".join(lines)


def json_schema(fields: tuple[Field, ...]) -> dict:
    """Fields as a JSON schema; a currency is an object of an amount and a currency."""

    def one(f: Field) -> dict:
        if f.type == "object":
            out = json_schema(f.fields)
        elif f.type == "array":
            out = {"type": "array", "items": one(f.item) if f.item else {"type": "string"}}
        elif f.type == "currency":
            out = {"type": "object", "properties": {"amount": {"type": "number"}, "currency": {"type": "string"}}}
        elif f.type == "enum":
            out = {"type": "string", "enum": list(f.enum_values)}
        else:
            out = {"type": f.type if f.type in ("number", "boolean") else "string"} | ({"format": "uri"} if f.type == "url" else {})
        return out | ({"description": f.description} if f.description else {})

    return {"type": "object", "properties": {f.name: one(f) for f in fields}, "required": [f.name for f in fields if f.required]}
