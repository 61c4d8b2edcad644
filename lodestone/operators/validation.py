"""Checks of generated assignments: structure, references, authority, completeness, states and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_sections(assignments: DataFrame, required: list[str]) -> DataFrame:
    """(assignment_id, missing): required sections that an assignment (assignment_id, sections) lacks."""
    lacks = F.array_sort(F.array_except(F.array(*map(F.lit, required)), "sections"))
    return assignments.select("assignment_id", lacks.alias("missing")).where(F.size("missing") > 0)


def broken_references(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, problem): links to fragments that are not there, or whose quoted text is not theirs."""
    found = links.join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    problem = F.when(F.col("content").isNull(), "unresolved").when(~F.contains("content", "quote"), "quote differs")
    return found.select("claim_id", "chunk_id", problem.alias("problem")).where("problem IS NOT NULL")


def authority(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, code): mandatory claims without primary evidence."""
    primary = evidence.where("knowledge_base_role = 'primary'").select("claim_id")
    return claims.where("mandatory").join(primary, "claim_id", "left_anti").select("claim_id", F.lit("MISSING_PRIMARY_EVIDENCE").alias("code"))


def requirement_coverage(requirements: DataFrame, claims: DataFrame) -> DataFrame:
    """(assignment_id, requirement): mandatory requirements that no supported claim covers."""
    covered = claims.where("verdict = 'supported'").select("assignment_id", "requirement")
    return requirements.where("mandatory").join(covered, ["assignment_id", "requirement"], "left_anti").select("assignment_id", "requirement")


def assignment_states(assignments: DataFrame, claims: DataFrame) -> DataFrame:
    """(assignment_id, validation_status, status, exportable): blocked while a mandatory claim is pending or not
    supported; complete exactly when passed."""
    bad = claims.groupBy("assignment_id").agg(F.bool_or(F.col("mandatory") & (F.col("verdict") != "supported")).alias("bad"))
    out = assignments.select("assignment_id").join(bad, "assignment_id", "left").withColumn("passed", ~F.coalesce("bad", F.lit(False)))
    return out.select("assignment_id", F.when(F.col("passed"), "passed").otherwise("blocked").alias("validation_status"), F.when(F.col("passed"), "complete").otherwise("incomplete").alias("status"), F.col("passed").alias("exportable"))


def after_edit(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` claims (claim_id, text, verdict, ...) with verdict 'pending' where the text is new or changed."""
    before = old.select("claim_id", F.col("text").alias("_old"), F.col("verdict").alias("_verdict"))
    same = F.col("_old").isNotNull() & (F.col("_old") == F.col("text"))
    return new.join(before, "claim_id", "left").withColumn("verdict", F.when(same, F.col("_verdict")).otherwise("pending")).drop("_old", "_verdict")


def benchmark_manifest(requests: DataFrame, least: int = 60, least_each: int = 8) -> DataFrame:
    """(category, requests, enough): distinct requests of each category, and of all as 'total'. ``requests`` has request_id
    and an array of categories, which may overlap."""
    each = requests.select("request_id", F.explode("categories").alias("category")).groupBy("category").agg(F.count_distinct("request_id").alias("requests"))
    whole = requests.agg(F.lit("total").alias("category"), F.count_distinct("request_id").alias("requests"))
    need = F.when(F.col("category") == "total", least).otherwise(least_each)
    return each.unionByName(whole).withColumn("enough", F.col("requests") >= need)


def evaluate(results: DataFrame) -> DataFrame:
    """(architecture, category, n, mean): results (architecture, categories, value) of a frozen set by category."""
    rows = results.select("architecture", "value", F.explode("categories").alias("category"))
    return rows.groupBy("architecture", "category").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
