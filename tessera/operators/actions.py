"""Proposed actions: which may be applied unseen, how risky they are, and what applied ones change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Policies of action types, and states of a job.
AUTO, ABOVE, BATCH, REVIEW = "always_auto", "auto_above_threshold", "batch_review", "always_review"
POLICIES = {
    "classify_page": AUTO,
    "enqueue_links": AUTO,
    "hint_entity_match": AUTO,
    "update_enum_map": AUTO,
    "flag_anomaly": AUTO,
    "generate_documentation": AUTO,
    "add_field": ABOVE,
    "modify_field": ABOVE,
    "set_normalization_rule": ABOVE,
    "define_category": ABOVE,
    "assign_category_fields": ABOVE,
    "match_entities": ABOVE,
    "set_source_trust": ABOVE,
    "reprocess_extraction": ABOVE,
    "merge_fields": BATCH,
    "rename_field": BATCH,
    "split_field": BATCH,
    "group_fields": BATCH,
    "resolve_conflict": BATCH,
    "infer_value": BATCH,
    "correct_value": BATCH,
    "split_entities": BATCH,
    "remove_field": REVIEW,
    "recommend_table_structure": REVIEW,
    "derive_field": REVIEW,
}
HIGH_RISK, MEDIUM_RISK = ("remove_field", "split_entities"), ("merge_fields", "split_field", "group_fields", "resolve_conflict", "correct_value")
JOB_STEPS = [
    ("pending", "queued"),
    ("queued", "running"),
    ("queued", "cancelled"),
    ("running", "paused"),
    ("running", "reconciling"),
    ("running", "failed"),
    ("running", "cancelled"),
    ("paused", "running"),
    ("paused", "cancelled"),
    ("reconciling", "completed"),
    ("reconciling", "failed"),
]


def policy(kind: Column, preset: str = "default") -> Column:
    """An action type's policy under a preset: trust_ai applies all, manual none, cautious reviews what a threshold would let through."""
    own = F.coalesce(F.create_map(*[F.lit(x) for pair in POLICIES.items() for x in pair])[kind], F.lit(REVIEW))
    if preset == "trust_ai":
        return F.lit(AUTO)
    if preset == "manual":
        return F.lit(REVIEW)
    return F.when(own == ABOVE, F.lit(BATCH)).otherwise(own) if preset == "cautious" else own


def risk(kind: Column) -> Column:
    return F.when(kind.isin(*HIGH_RISK), "high").when(kind.isin(*MEDIUM_RISK), "medium").otherwise("low")


def triage(actions: DataFrame, preset: str = "default", threshold: float = 0.8) -> DataFrame:
    """actions (type, confidence) with policy, risk and whether they apply unseen."""
    out = actions.withColumn("policy", policy(F.col("type"), preset)).withColumn("risk", risk(F.col("type")))
    return out.withColumn("auto", (F.col("policy") == AUTO) | ((F.col("policy") == ABOVE) & (F.col("confidence") >= threshold)))


def overwrite_values(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """cells (entity, field, value) under changes (entity, field, value, seq): the last change of a field holds, new fields come in."""
    last = Window.partitionBy("entity", "field").orderBy(F.desc("seq"))
    new = changes.withColumn("__n", F.row_number().over(last)).where("__n = 1").select("entity", "field", "value")
    return cells.join(new, ["entity", "field"], "left_anti").unionByName(new)


def review(actions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pending actions under verdicts (id, verdict: approved or rejected); others stay as they are."""
    joined = actions.join(verdicts, "id", "left")
    return joined.withColumn("status", F.when((F.col("status") == "pending") & F.col("verdict").isin("approved", "rejected"), F.col("verdict")).otherwise(F.col("status"))).drop("verdict")
