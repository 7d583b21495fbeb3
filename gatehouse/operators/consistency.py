"""Consistency of a repository's documents, artifacts and changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.config import parsed
from gatehouse.functions.globs import glob_matches, globs_regex
from gatehouse.functions.text import link_targets, resolved
from gatehouse.functions.workflows import action_line_numbers, byte_lines, moves_pins_only
from gatehouse.sources.repositories import UNKNOWN_MODE, WORKFLOWS, changed_paths
from gatehouse.sources.staging import staged

#: Kinds of review that changed paths call for (fixed values).
ROUTES = {
    "readability-template": ("README.md", "docs/**"),
    "product-design-audit": ("README.md", "docs/**", "web/**", "ui/**"),
    "security-guidance": ("SECURITY.md", "**/auth/**", "**/security/**", "*.pem"),
    "creative-production": ("assets/**", "images/**", "**/*.png", "**/*.svg", "**/*.mp4"),
    "openai-developers": ("**/openai/**", "**/*openai*", "**/*chatgpt*"),
    "github-workflow": (".github/**",),
}


def link_findings(documents: DataFrame, tracked: DataFrame) -> DataFrame:
    """``repo_id, finding`` of links that leave the repository or lead to no tracked file (a folder is none), and of documents that aren't UTF-8.

    ``documents(repo_id, path, content)``: bytes or texts, null where it could not be read; ``tracked(repo_id, path)``.
    """
    text = F.col("content").cast("string")
    read = documents.select("repo_id", "path", F.coalesce(F.is_valid_utf8(text), F.lit(False)).alias("valid"), text.alias("content"))
    unreadable = read.where("not valid").select("repo_id", F.concat(F.lit("markdown_unreadable:"), "path").alias("finding"))
    links = read.where("valid").select("repo_id", "path", F.explode(link_targets(F.col("content"))).alias("target")).withColumn("to", resolved(F.col("path"), F.col("target"))).distinct()
    named = lambda kind: F.concat(F.lit(f"markdown_link_{kind}:"), "path", F.lit(":"), "target").alias("finding")
    outside = links.where("to is null").select("repo_id", named("outside_repo"))
    missing = links.where("to is not null").join(tracked.select("repo_id", F.col("path").alias("to")), ["repo_id", "to"], "left_anti").select("repo_id", named("missing"))
    return unreadable.unionByName(outside).unionByName(missing)


def readme_findings(contracts: DataFrame, files: DataFrame) -> DataFrame:
    """``repo_id, finding`` of ``contracts(repo_id, required_paths, commands)``: paths that don't exist and commands that README.md doesn't show.

    ``files(repo_id, path, tracked, content)`` are those on disk; their folders exist too.
    """
    readme = files.where("path = 'README.md'").groupBy("repo_id").agg(F.bool_or("tracked").alias("tracked"), F.first(F.col("content").cast("string")).alias("body"))
    joined = contracts.join(readme, "repo_id", "left").withColumn("valid", F.coalesce(F.is_valid_utf8("body"), F.lit(False)))
    closed = joined.where("not coalesce(tracked, false) or not valid").select("repo_id", F.when(F.col("tracked") & ~F.col("valid"), "readme_unreadable").otherwise("readme_unreadable:README.md").alias("finding"))
    open_ = joined.where("tracked and valid")
    shown = open_.select("repo_id", "body", F.posexplode("commands.text").alias("at", "text")).where(~F.contains("body", F.col("text")))
    commands = shown.select("repo_id", F.concat(F.lit("readme_command_missing:command-"), F.col("at") + 1, F.lit("-"), F.substring(F.sha2("text", 256), 1, 12)).alias("finding"))
    wanted = open_.select("repo_id", F.explode(F.array_distinct(F.concat("required_paths", F.flatten("commands.paths")))).alias("path")).withColumn("to", resolved(F.lit(""), F.col("path")))
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), k), "/"))
    there = files.select("repo_id", F.explode(parents).alias("to")).distinct()
    paths = wanted.where("to <> ''").join(there, ["repo_id", "to"], "left_anti").select("repo_id", F.concat(F.lit("readme_path_missing:"), "path").alias("finding"))
    return closed.unionByName(commands).unionByName(paths)


def artifact_findings(artifacts: DataFrame, files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """``repo_id, path, state``: missing, drift or current, by SHA-256 of ``files(repo_id, path, content)``.

    With ``changes(repo_id, path)``, artifacts also have ``sources``, an array of globs: an artifact that didn't change while a
    source did is update_missing, in a row of its own beside missing or drift and in the place of current.
    """
    digests = files.select("repo_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    joined = artifacts.select("repo_id", "path", "sha256").join(digests, ["repo_id", "path"], "left")
    found = joined.select("repo_id", "path", F.when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("sha256"), "drift").otherwise("current").alias("state"))
    if changes is None:
        return found
    changed = changes.select("repo_id", "path").distinct()
    touched = glob_matches(artifacts.select("repo_id", F.col("path").alias("artifact"), F.explode("sources").alias("glob")), changed).select("repo_id", F.col("artifact").alias("path")).distinct()
    late = touched.join(changed, ["repo_id", "path"], "left_anti").withColumn("late", F.lit(True))
    states = F.array_compact(F.array(F.when(F.col("late"), F.lit("update_missing")), F.when(F.col("late").isNull() | (F.col("state") != "current"), F.col("state"))))
    return found.join(late, ["repo_id", "path"], "left").select("repo_id", "path", F.explode(states).alias("state"))


def pin_updates(versions: DataFrame) -> DataFrame:
    """``repo_id, path`` of workflows whose change only moves the commits that actions are pinned to, of ``sources.repositories.read_versions``' rows.

    The file is a workflow of the repository itself, modified in place (git's M) as a regular file of one mode at the base, in the index and on disk. Whatever could not
    be read, or is ambiguous, is no such update.
    """
    regular = F.col("base_mode").isin("100644", "100755") & (F.col("index_mode") == F.col("base_mode")) & (F.col("disk_mode") == F.col("base_mode"))
    rows = versions.where(F.col("error").isNull() & F.col("path").rlike(WORKFLOWS.replace(r"\Z", r"\z")) & (F.col("kind") == "M") & regular & F.col("before").isNotNull() & F.col("after").isNotNull())
    lines = rows.select("repo_id", "path", *[c for side in ("before", "after") for c in (byte_lines(F.col(side)).alias(side), action_line_numbers(F.col(side)).alias(f"{side}_actions"))])
    return lines.where(moves_pins_only(*[F.col(c) for c in ("before", "after", "before_actions", "after_actions")])).select("repo_id", "path").distinct()


def impact_findings(changes: DataFrame, rules: Sequence[Mapping[str, Any]], pins: DataFrame | None = None) -> DataFrame:
    """``repo_id, finding`` of rules whose ``change`` paths changed while none of ``requires_any`` did. The rules are literals of the plan.

    A rule with ``exempt`` true does not hold where all paths that it is about, one at least, are ``pins(repo_id, path)``.
    """
    changed = changes.select("repo_id", "path") if pins is None else changes.select("repo_id", "path").join(pins.withColumn("pin", F.lit(True)), ["repo_id", "path"], "left")
    pin = F.lit(False) if pins is None else F.coalesce("pin", F.lit(False))
    aggs = []
    for k, rule in enumerate(rules, 1):
        on = lambda key, r=rule: F.col("path").rlike(globs_regex(r[key]))
        spared = F.bool_and(F.when(on("change"), pin)) if rule.get("exempt") else F.lit(False)
        aggs.append(F.when(F.bool_or(on("change")) & ~spared & ~F.bool_or(on("requires_any")), F.lit(f"related_docs_update_missing:impact-{k}")).alias(f"r{k}"))
    wide = changed.groupBy("repo_id").agg(*aggs)
    return wide.select("repo_id", F.explode(F.array_compact(F.array(*[f"r{k}" for k in range(1, len(rules) + 1)]))).alias("finding"))


def capability_routes(changes: DataFrame, routes: Mapping[str, Sequence[str]] = ROUTES) -> DataFrame:
    """``repo_id, route, paths`` of every route with a changed path, paths sorted and each once. A path is matched once, however often it changed."""
    changed = changes.select("repo_id", "path").distinct()
    matching = F.array_compact(F.array(*[F.when(F.col("path").rlike(globs_regex(g)), F.lit(r)) for r, g in routes.items()]))
    routed = changed.select("path").distinct().select("path", F.explode(matching).alias("route"))
    return changed.join(routed, "path").groupBy("repo_id", "route").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def impact_results(rules: DataFrame, changes: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """``repo_id, at, status, action_ref_update_only`` of every one of ``rules(repo_id, at, change, requires_any, exempt)``, repositories' own.

    A rule fails where ``change`` paths changed, unless one of ``requires_any`` did, or it is exempt and all the paths that it is about, one at least, are ``pins(repo_id, path)``.
    """
    sides = F.array(F.struct(F.lit(True).alias("about"), F.col("change").alias("globs")), F.struct(F.lit(False).alias("about"), F.col("requires_any").alias("globs")))
    globs = rules.select("repo_id", "at", F.inline(sides)).select("repo_id", "at", "about", F.explode("globs").alias("glob"))
    met = glob_matches(globs, changes.select("repo_id", "path"))
    if pins is None:
        met = met.withColumn("pin", F.lit(False))
    else:
        met = met.join(pins.select("repo_id", "path").distinct().withColumn("pinned", F.lit(True)), ["repo_id", "path"], "left").withColumn("pin", F.coalesce("pinned", F.lit(False)))
    told = met.groupBy("repo_id", "at").agg(F.bool_or("about").alias("hit"), F.bool_and(F.when(F.col("about"), F.col("pin"))).alias("all_pins"), F.bool_or(~F.col("about")).alias("met"))
    rows = rules.select("repo_id", "at", "exempt").join(told, ["repo_id", "at"], "left")
    hit, spared = F.coalesce("hit", F.lit(False)), F.coalesce(F.col("exempt") & F.col("all_pins"), F.lit(False))
    return rows.select("repo_id", "at", F.when(hit & ~spared & ~F.coalesce("met", F.lit(False)), "fail").otherwise("pass").alias("status"), (hit & spared).alias("action_ref_update_only"))


def rule_findings(rules: DataFrame, changes: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """``repo_id, finding`` of the rules that fail by ``impact_results``; ``rules`` may lack ``exempt``."""
    wanted = rules if "exempt" in rules.columns else rules.withColumn("exempt", F.lit(False))
    return impact_results(wanted, changes, pins).where("status = 'fail'").select("repo_id", F.concat(F.lit("related_docs_update_missing:impact-"), "at").alias("finding"))


def ratchet(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """``repo_id, accepted, new, resolved`` (sorted) of ``(repo_id, finding)`` rows against the accepted ones."""
    now, old = findings.select("repo_id", "finding", F.lit(True).alias("now")).distinct(), baseline.select("repo_id", "finding", F.lit(True).alias("old")).distinct()
    both = now.join(old, ["repo_id", "finding"], "full")
    part = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("finding"))))
    has, had = F.col("now").isNotNull(), F.col("old").isNotNull()
    return both.groupBy("repo_id").agg(part(has & had).alias("accepted"), part(has & ~had).alias("new"), part(~has & had).alias("resolved"))


def gate_status(mode: Column, findings: Column, new: Column, resolved_: Column, unreadable: Column) -> Column:
    """Status by mode: what can't be read is a tool_error; ratchet fails on new and on resolved findings, enforce on any, shadow only reports."""
    return (
        F.when(mode.isNull(), "not_configured")
        .when(unreadable, "tool_error")
        .when(mode == "ratchet", F.when((F.size(new) > 0) | (F.size(resolved_) > 0), "fail").otherwise("pass"))
        .when(F.size(findings) == 0, "pass")
        .when(mode == "enforce", "fail")
        .otherwise("shadow_findings")
    )


INVENTORY, DIFF = "git_consistency_inventory_failed", "git_consistency_diff_failed"


def _faults(repos: DataFrame, files: DataFrame, changes: DataFrame | None) -> DataFrame:
    """``repo_id, unlisted, undiffed``: whether a repository's files, and its changes, could not be told in full. Every repository has a row.

    A source's error rows rule their repository's check whatever else was read; no row at all is no answer either.
    """
    ids = repos.select("repo_id").distinct()
    has = lambda df, c: c in df.columns
    bad = F.lit(False)
    if has(files, "error"):
        bad = bad | (F.col("error").isNotNull() & (F.col("path").isNull() | (F.col("error") == UNKNOWN_MODE)))
    if has(files, "stage"):
        bad = bad | (F.col("tracked") & (F.col("stage") != 0))
    listed = files.groupBy("repo_id").agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("bad"))
    out = ids.join(listed, "repo_id", "left").select("repo_id", F.coalesce("bad", F.lit(True)).alias("unlisted"))
    if has(repos, "error"):
        out = out.join(repos.groupBy("repo_id").agg(F.bool_or(F.col("error").isNotNull()).alias("fault")), "repo_id").select("repo_id", (F.col("unlisted") | F.col("fault")).alias("unlisted"))
    if changes is None:
        return out.withColumn("undiffed", F.lit(False))
    answer = F.col("error").isNull() & (F.col("scope") == "base") if has(changes, "scope") else F.lit(True)
    fault = F.col("error").isNotNull() if has(changes, "error") else F.lit(False)
    told = changes.groupBy("repo_id").agg(F.bool_or(fault).alias("failed"), F.bool_or(answer).alias("told"))
    # a bare list of paths holds no word on repositories without changes
    silent = F.lit(has(changes, "scope"))
    return out.join(told, "repo_id", "left").select("repo_id", "unlisted", F.coalesce(F.col("failed") | ~F.col("told"), silent).alias("undiffed"))


def check(
    repos: DataFrame,
    configs: DataFrame,
    files: DataFrame,
    schema_id: str,
    changes: DataFrame | None = None,
    require_config: bool = False,
    require_mode: str | None = None,
    versions: DataFrame | None = None,
) -> DataFrame:
    """``repo_id, mode, status, findings, accepted, new, resolved``: every repository against its own configuration.

    ``configs(repo_id, content)``; ``files(repo_id, path, tracked, content)`` on disk, with ``stage`` and ``error`` as ``sources.repositories`` reads them; ``changes`` since a base
    as it reads them, or ``(repo_id, path)`` alone, None without a base; ``versions`` where rules spare changes that only move pinned commits.

    What could not be read is a tool_error and never a pass: a configuration that is not valid, a repository whose files are not all told (an error, a conflict, an
    unknown mode, no row at all), a base without an answer, changes that rules ask for without a base, and a document that can't be read. Paths are
    matched before contents are fetched. Several branches read ``files``: give a stored table (``sources.snapshots``), or git is asked again by each.
    """
    invalid, parts = parsed(F.col("content"), schema_id)
    unread = F.coalesce(F.col("error").isNotNull(), F.lit(False)) if "error" in configs.columns else F.lit(False)
    given = configs.select("repo_id", F.when(unread, F.lit(b"")).otherwise(F.col("content").cast("binary")).alias("content"))
    configured = repos.select("repo_id").join(given, "repo_id", "left").select("repo_id", invalid.alias("invalid"), parts.alias("c")).join(_faults(repos, files, changes), "repo_id")
    sensitive = F.coalesce((F.size("c.impact") > 0) | F.exists("c.artifacts", lambda a: F.size(a["sources"]) > 0), F.lit(False))
    fault = (
        F.when(F.col("invalid"), "invalid_consistency_config")
        .when(F.col("unlisted"), INVENTORY)
        .when(F.col("undiffed") & F.col("c").isNotNull(), DIFF)
        .when(sensitive & F.lit(changes is None), "change_sensitive_scope_unavailable")
    )
    configured = staged(configured.withColumn("broken", fault), "configured")  # a row a repository; ten branches read it
    live = configured.where("c is not null and broken is null").select("repo_id", "c.*")
    changed = files.select("repo_id", "path").limit(0) if changes is None else changed_paths(changes) if "scope" in changes.columns else changes
    readable = F.col("path").isNotNull() if "error" in files.columns else F.lit(True)
    tracked = files.where(F.col("tracked") & readable)

    # without contracts the README is no document of the check
    patterns = live.select("repo_id", "has_contracts", F.explode("include").alias("glob"))
    matched = glob_matches(patterns, tracked.select("repo_id", "path").unionByName(live.select("repo_id", F.lit("README.md").alias("path")).distinct()))
    about_readme = matched.where("path = 'README.md' and not has_contracts").select("repo_id", "glob").distinct()
    documents = matched.join(about_readme, ["repo_id", "glob"], "left_anti").select("repo_id", "path").distinct()
    documents = tracked.select("repo_id", "path", "content").join(documents, ["repo_id", "path"])
    rules = live.select("repo_id", F.posexplode("impact").alias("k", "r")).select("repo_id", (F.col("k") + 1).alias("at"), "r.*")
    artifacts = live.select("repo_id", F.explode("artifacts").alias("a")).select("repo_id", "a.*")
    late = artifact_findings(artifacts, files, changed).where("state <> 'current'").select("repo_id", F.concat(F.lit("generated_artifact_"), "state", F.lit(":"), "path").alias("finding"))
    contracts = readme_findings(live.where("has_contracts").select("repo_id", "required_paths", "commands"), files)
    impact = rule_findings(rules, changed, None if versions is None else pin_updates(versions))
    found = reduce(DataFrame.unionByName, [link_findings(documents, tracked.select("repo_id", "path")), contracts, impact, late]).distinct()

    baseline = live.where("mode = 'ratchet'").select("repo_id", F.explode("baseline").alias("finding"))
    none = F.array().cast("array<string>")
    listed = found.groupBy("repo_id").agg(F.array_sort(F.collect_list("finding")).alias("found"))
    sets = ratchet(found.join(live.where("mode = 'ratchet'").select("repo_id"), "repo_id", "left_semi"), baseline)
    rows = configured.select("repo_id", "broken", F.col("c.mode").alias("mode")).join(listed, "repo_id", "left").join(sets, "repo_id", "left")
    rows = rows.select("repo_id", "broken", F.when(F.col("broken").isNull(), F.col("mode")).alias("mode"), F.when(F.col("broken").isNotNull(), F.array("broken")).otherwise(F.coalesce("found", none)).alias("findings"), *[F.coalesce(c, none).alias(c) for c in ("accepted", "new", "resolved")])
    unreadable = F.exists("findings", lambda x: F.startswith(x, F.lit("markdown_unreadable:")) | F.startswith(x, F.lit("readme_unreadable:")))
    status = F.when(F.col("broken").isNotNull(), "tool_error").otherwise(gate_status(F.col("mode"), F.col("findings"), F.col("new"), F.col("resolved"), unreadable))
    rows = rows.withColumn("status", status)
    missing = (F.col("status") == "not_configured") if require_config else F.lit(False)
    other = ~missing & ~F.col("mode").eqNullSafe(require_mode) if require_mode else F.lit(False)
    rows = rows.withColumn("findings", F.when(missing, F.array(F.lit("required_consistency_config_missing"))).when(other, F.array_sort(F.array_union("findings", F.array(F.lit("required_consistency_mode_mismatch"))))).otherwise(F.col("findings")))
    return rows.select("repo_id", "mode", F.when(missing | other, "tool_error").otherwise(F.col("status")).alias("status"), "findings", "accepted", "new", "resolved")
