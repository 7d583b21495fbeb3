"""Checks of repositories: each returns ``repo_id, name, status`` rows with details, none of them the matched text.

An unknown is a status of its own and never a pass; a repository without any row of a check has no status.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.patterns import HOME_PATHS, SECRETS, content_has_any, effective_identity, evidence_label

#: Documents that a repository must have (fixed values).
REQUIRED_DOCUMENTS = ("README.md", "LICENSE", "SECURITY.md", "CONTRIBUTING.md", "PREFLIGHT.md")
#: Root files that declare dependencies (fixed values).
DEPENDENCY_FILES = ("pyproject.toml", "requirements.txt", "requirements-dev.txt", "Pipfile", "poetry.lock", "uv.lock", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.toml", "Cargo.lock", "go.mod", "go.sum", "Gemfile", "Gemfile.lock", "pom.xml", "build.gradle", "build.gradle.kts")
#: Checks that decide a status, those only without a base, and those only for a release (fixed values).
AUDITED = ("clean_worktree", "secret_scan", "personal_path_scan", "commit_identity", "origin", "repository_consistency")
AUDITED_UNSCOPED = ("required_documents", "dependency_configuration", "ci_configuration")
AUDITED_RELEASE = ("readme_release_design",)
MAX_OBJECT_BYTES = 2_000_000


def status_of(failed: Column, unknown: Column | None = None) -> Column:
    out = F.when(failed, F.lit("fail"))
    return (out if unknown is None else out.when(unknown, F.lit("unknown"))).otherwise(F.lit("pass"))


def secret_scan(files: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """repo_id, finding_count, status. ``files(repo_id, content)``; a secret in ``history(repo_id, oid, content)`` counts once per object more. Contents are bytes or texts."""
    hits = files.select("repo_id", content_has_any(F.col("content"), SECRETS).alias("hit")).groupBy("repo_id").agg(F.count_if("hit").alias("n"))
    if history is not None:
        old = history.select("repo_id", "oid", content_has_any(F.col("content"), SECRETS).alias("hit")).groupBy("repo_id", "oid").agg(F.max("hit").alias("hit"))
        hits = hits.unionByName(old.groupBy("repo_id").agg(F.count_if("hit").alias("n")))
    return hits.groupBy("repo_id").agg(F.sum("n").alias("finding_count")).withColumn("status", status_of(F.col("finding_count") > 0))


def personal_path_scan(files: DataFrame) -> DataFrame:
    """repo_id, finding_count, labels (a safely shown path for each finding, sorted), status of ``files(repo_id, path, content)``; contents are bytes or texts."""
    hits = files.select("repo_id", "path", content_has_any(F.col("content"), HOME_PATHS).alias("hit"))
    found = hits.groupBy("repo_id").agg(F.count_if("hit").alias("finding_count"), F.array_sort(F.collect_list(F.when(F.col("hit"), evidence_label(F.col("path"))))).alias("labels"))
    return found.withColumn("status", status_of(F.col("finding_count") > 0))


def history_objects(objects: DataFrame, max_bytes: int = MAX_OBJECT_BYTES) -> DataFrame:
    """Blobs worth reading, each once per repository; filters on metadata reach the scan before contents are read."""
    return objects.where((F.col("type") == "blob") & (F.col("size") <= max_bytes)).dropDuplicates(["repo_id", "oid"])


def commit_identity(commits: DataFrame, expected: str | None) -> DataFrame:
    """repo_id, identities, mismatches, policy, status of ``commits(repo_id, author, committer)``."""
    pairs = commits.select("repo_id", effective_identity(F.col("author")).alias("author"), effective_identity(F.col("committer")).alias("committer")).distinct()
    wrong = F.lit(False) if expected is None else (F.col("author") != expected) | (F.col("committer") != expected)
    out = pairs.groupBy("repo_id").agg(F.count("*").alias("identities"), F.count_if(wrong).alias("mismatches"))
    return out.select("*", F.lit("expected_identity" if expected else "not_configured").alias("policy"), status_of(F.col("mismatches") > 0).alias("status"))


def required_documents(repos: DataFrame, files: DataFrame, names: Sequence[str] = REQUIRED_DOCUMENTS, marker: str | None = None, marked: str = "PREFLIGHT.md") -> DataFrame:
    """repo_id, missing, invalid, status. A document named ``marked`` must hold ``marker`` where one is given."""
    wanted = repos.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, names))).alias("path"))
    valid = F.lit(True) if marker is None else (F.col("path") != marked) | F.coalesce(F.contains(F.col("content"), F.lit(marker)), F.lit(False))
    there = files.where(F.col("path").isin(*names)).groupBy("repo_id", "path").agg(F.max(valid).alias("valid"))
    joined = wanted.join(there, ["repo_id", "path"], "left")
    out = joined.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.when(F.col("valid").isNull(), F.col("path")))).alias("missing"), F.array_sort(F.collect_list(F.when(~F.col("valid"), F.col("path")))).alias("invalid"))
    return out.withColumn("status", status_of((F.size("missing") > 0) | (F.size("invalid") > 0)))


def dependency_configuration(repos: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, files, status: never a failure."""
    found = files.where(F.col("path").isin(*DEPENDENCY_FILES)).groupBy("repo_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    out = repos.select("repo_id").distinct().join(found, "repo_id", "left")
    return out.select("repo_id", F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.when(F.col("files").isNull(), "not_applicable").otherwise("pass").alias("status"))


def ci_configuration(repos: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, workflows, invalid, status: without a workflow the result is unknown."""
    flows = files.where(F.col("path").rlike(r"^\.github/workflows/[^/]*\.y[^/]*ml$")).groupBy("repo_id")
    found = flows.agg(F.count("*").alias("workflows"), F.count_if(~F.coalesce(F.col("content").rlike(r"(?m)^jobs\s*:"), F.lit(False))).alias("invalid"))
    out = repos.select("repo_id").distinct().join(found, "repo_id", "left").fillna(0, ["workflows", "invalid"])
    return out.withColumn("status", status_of(F.col("invalid") > 0, F.col("workflows") == 0))


def rollup(checks: DataFrame, audited: Sequence[str] = AUDITED + AUDITED_UNSCOPED) -> DataFrame:
    """One status per repository: tool_error before blocked (a failure or an unknown) before pass."""
    scoped = checks.where(F.col("name").isin(*audited))
    out = scoped.groupBy("repo_id").agg(F.bool_or(F.col("status") == "tool_error").alias("broken"), F.bool_or(F.col("status").isin("fail", "unknown")).alias("bad"), F.count("*").alias("checks"))
    return out.select("repo_id", "checks", F.when(F.col("broken"), "tool_error").when(F.col("bad"), "blocked").otherwise("pass").alias("status"))


def audited_checks(scoped: bool = False, release: bool = False) -> tuple[str, ...]:
    return AUDITED + (() if scoped else AUDITED_UNSCOPED) + (AUDITED_RELEASE if release else ())


def as_checks(**results: DataFrame) -> DataFrame:
    """Check rows of several results by name."""
    rows = [df.select("repo_id", F.lit(name).alias("name"), "status") for name, df in results.items()]
    return reduce(DataFrame.unionByName, rows)


def exit_code(status: Column, kind: str = "scan") -> Column:
    """A process's exit code of a status, by ``kind`` of report: scan, dialogue, consistency or readme."""
    if kind == "dialogue":
        return F.when(status == "ready_after_confirmation", 0).when(status.isin("blocked", "needs_human_input"), 1).otherwise(2)
    if kind == "consistency":
        return F.when(status.isin("pass", "not_configured"), 0).otherwise(1)
    if kind == "readme":
        return F.when(status == "pass", 0).otherwise(1)
    return F.when(status == "pass", 0).when(status == "tool_error", 2).otherwise(1)
