"""The assembled scan of repositories: every check, its status, and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.patterns import HOME_PATHS, SECRETS, content_has_any, effective_identity, evidence_label, redacted_remote
from gatehouse.operators import readme
from gatehouse.operators.checks import DEPENDENCY_FILES, MAX_OBJECT_BYTES, REQUIRED_DOCUMENTS, audited_checks, exit_code, status_of
from gatehouse.sources.repositories import UNREADABLE

#: A person has to decide about every publication (fixed value).
DECISION = "blocked_human_review_required"
_NAMES = "array<string>"


def _listed(when: Column, value: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(when, value)))


def _worktree(files: DataFrame, marked: str, marker: str | None) -> DataFrame:
    """One pass over the files on disk, and one row a repository: counts are combined before the shuffle, of texts only README.md moves."""
    text = F.col("content").cast("string")
    readable = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    seen = files.select(
        "repo_id",
        "path",
        (F.col("error").isNotNull() & (F.col("path").isNull() | (F.col("error") != UNREADABLE)) if "error" in files.columns else F.lit(False)).alias("broken"),
        (F.when(F.col("path").isNotNull() & (F.col("error") == UNREADABLE), F.struct((~F.col("tracked") if "tracked" in files.columns else F.lit(False)).alias("untracked"), "path")) if "error" in files.columns else F.lit(None).cast("struct<untracked:boolean,path:string>")).alias("unread"),
        content_has_any(F.col("content"), SECRETS).alias("secret"),
        content_has_any(F.col("content"), HOME_PATHS).alias("home"),
        F.col("path").rlike(r"^\.github/workflows/[^/]*\.y[^/]*ml\z").alias("flow"),
        (readable & F.coalesce(text.rlike(r"(?m)^jobs\s*:"), F.lit(False))).alias("has_jobs"),
        (readable & (F.lit(True) if marker is None else F.contains(text, F.lit(marker)))).alias("has_marker"),
        F.when(F.col("path") == "README.md", text).alias("readme"),
    )
    return seen.groupBy("repo_id").agg(
        F.bool_or("broken").alias("broken_files"),
        F.min("unread").getField("path").alias("unread_file"),
        F.count_if("secret").alias("secrets"),
        _listed(F.col("home"), evidence_label(F.col("path"))).alias("homes"),
        F.collect_set(F.when(F.col("path").isin(*REQUIRED_DOCUMENTS), F.col("path"))).alias("documents"),
        F.bool_or((F.col("path") == marked) & ~F.col("has_marker")).alias("unmarked"),
        F.array_sort(F.collect_set(F.when(F.col("path").isin(*DEPENDENCY_FILES), F.col("path")))).alias("dependencies"),
        F.count_if("flow").alias("workflows"),
        _listed(F.col("flow") & ~F.col("has_jobs"), F.col("path")).alias("bad_workflows"),
        F.max("readme").alias("readme"),
    )


def object_verdicts(objects: DataFrame) -> DataFrame:
    """``oid, secret, home, error`` of ``objects(oid, content)``, each content matched once, whatever repositories hold it; an object has one row."""
    broken = F.col("error") if "error" in objects.columns else F.lit(None).cast("string")
    seen = objects.select("oid", content_has_any(F.col("content"), SECRETS).alias("secret"), content_has_any(F.col("content"), HOME_PATHS).alias("home"), broken.alias("error"))
    return seen.groupBy("oid").agg(F.bool_or("secret").alias("secret"), F.bool_or("home").alias("home"), F.min("error").alias("error"))


def history_of(inventory: DataFrame, verdicts: DataFrame, max_bytes: int = MAX_OBJECT_BYTES) -> DataFrame:
    """``repo_id, oid, secret, home, error``: every repository's blobs of at most ``max_bytes`` with the verdicts on them.

    ``inventory(repo_id, oid, type, size)`` and its error rows; a blob without a verdict is an error, not a pass.
    """
    fault = F.col("error") if "error" in inventory.columns else F.lit(None).cast("string")
    listed = inventory.select("repo_id", "oid", "type", "size", fault.alias("fault")).where(F.col("fault").isNotNull() | ((F.col("type") == "blob") & (F.col("size") <= max_bytes)))
    joined = listed.join(verdicts.withColumn("known", F.lit(True)), "oid", "left")
    error = F.coalesce("fault", "error", F.when(F.col("known").isNull(), "NoVerdict"))
    return joined.select("repo_id", "oid", F.coalesce("secret", F.lit(False)).alias("secret"), F.coalesce("home", F.lit(False)).alias("home"), error.alias("error"))


def _history(objects: DataFrame) -> DataFrame:
    """Labels of objects with findings, each once; ``objects`` have contents, or the verdicts on them."""
    label = F.concat(F.lit("history:"), F.substring("oid", 1, 12))
    flags = [content_has_any(F.col("content"), p).alias(k) for k, p in (("secret", SECRETS), ("home", HOME_PATHS))] if "content" in objects.columns else ["secret", "home"]
    hits = objects.select("repo_id", label.alias("label"), *flags, F.col("error").isNotNull().alias("broken") if "error" in objects.columns else F.lit(False).alias("broken"))
    found = hits.groupBy("repo_id").agg(F.bool_or("broken").alias("broken_history"), F.size(F.collect_set(F.when(F.col("secret"), F.col("label")))).alias("old_secrets"), F.array_sort(F.collect_set(F.when(F.col("home"), F.col("label")))).alias("old_homes"))
    return found


def _identities(commits: DataFrame, expected: str | None) -> DataFrame:
    broken = F.col("error").isNotNull() if "error" in commits.columns else F.lit(False)
    pairs = commits.select("repo_id", "author", "committer", broken.alias("broken")).distinct()
    wrong = F.lit(False) if expected is None else ~F.col("broken") & (~F.col("author").eqNullSafe(expected) | ~F.col("committer").eqNullSafe(expected))
    return pairs.groupBy("repo_id").agg(F.bool_or("broken").alias("broken_log"), F.count_if(~F.col("broken")).alias("identity_count"), F.count_if(wrong).alias("mismatch_count"))


def _checks(expected: str | None, scoped: bool, release: bool, asked: bool) -> dict[str, Column]:
    """A struct of status and details for every check, over one wide row a repository."""
    part = lambda status, **more: F.struct(status.alias("status"), *[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in more.items()])
    none = F.array().cast(_NAMES)
    missing = none if scoped else F.array_except(F.array(*map(F.lit, REQUIRED_DOCUMENTS)), F.coalesce("documents", none))
    invalid = none if scoped else F.when(F.coalesce("unmarked", F.lit(False)), F.array(F.col("marked"))).otherwise(none)
    documents = F.lit("not_evaluated") if scoped else status_of((F.size(missing) > 0) | (F.size(invalid) > 0))
    count = F.coalesce("secrets", F.lit(0)) + F.coalesce("old_secrets", F.lit(0))
    paths = F.concat(F.coalesce("homes", none), F.coalesce("old_homes", none))
    now = [effective_identity(F.col(c)) for c in ("now_author", "now_committer")]
    if expected is None:
        effective, unlike = F.lit("not_evaluated"), F.lit(0)
    else:
        # both wrong by the same name is one mismatch
        unlike = F.size(F.array_distinct(F.array_compact(F.array(*[F.when(c != expected, c) for c in now]))))
        effective = F.when(unlike > 0, "fail").when(now[0].isNull() | now[1].isNull(), "unknown").otherwise("pass")
    mismatches = F.coalesce("mismatch_count", F.lit(0))
    dependencies, workflows, bad = F.coalesce("dependencies", none), F.coalesce("workflows", F.lit(0)), F.coalesce("bad_workflows", none)
    out = {
        "clean_worktree": part(status_of(F.col("dirty"))),
        "required_documents": part(documents, missing=missing, invalid=invalid),
        "secret_scan": part(status_of(count > 0), finding_count=count),
        "personal_path_scan": part(status_of(F.size(paths) > 0), files=paths),
        "commit_identity": part(
            status_of((mismatches > 0) | (effective == "fail"), effective == "unknown"),
            policy="expected_identity" if expected else "not_configured",
            identity_count=F.coalesce("identity_count", F.lit(0)),
            mismatch_count=mismatches,
            effective_identity=effective,
            effective_mismatch_count=unlike,
        ),
        "dependency_configuration": part(F.when(F.size(dependencies) > 0, "pass").otherwise("not_applicable"), files=dependencies),
        "dependency_vulnerability_audit": part(F.when(F.size(dependencies) > 0, "unknown").otherwise("not_applicable"), reason="requires_ecosystem_specific_current_audit"),
        "ci_configuration": part(status_of(F.size(bad) > 0, workflows == 0), workflow_count=workflows, invalid_files=bad),
        "ci_runtime_result": part(F.when(workflows > 0, "unknown").otherwise("not_applicable"), reason="requires_current_remote_ci_evidence"),
        "human_visual_review": part(F.lit("unknown"), reason="explicit_human_review_required"),
        "origin": part(status_of(F.lit(False), F.coalesce(F.col("origin"), F.lit("")) == ""), url=redacted_remote(F.col("origin"))),
        "repository_consistency": part(F.coalesce("consistency.status", F.lit("unknown" if asked else "not_configured")), mode=F.col("consistency.mode"), findings=F.coalesce("consistency.findings", none)),
    }
    if release:
        passed = F.col("design.status") == "pass"
        out["readme_release_design"] = part(F.when(passed, "pass").otherwise("fail"), design_status=F.col("design.status"), release_gate=F.col("design.release_gate"), codes=F.col("design.codes"), recommended=F.col("design.recommended"), human_visual_review_required=True)
    return out


def scan(
    repos: DataFrame,
    files: DataFrame,
    commits: DataFrame,
    objects: DataFrame | None = None,
    identities: DataFrame | None = None,
    consistency: DataFrame | None = None,
    bases: DataFrame | None = None,
    expected: str | None = None,
    release: bool = False,
    marked: str = "PREFLIGHT.md",
    marker: str | None = None,
    consistency_bases: DataFrame | None = None,
    consistency_expected: bool = True,
) -> DataFrame:
    """``repo_id, status, issues, checks, exit_code, report``: one row for every row of ``repos``.

    The tables are those of ``sources.repositories``: ``repos(repo_id, head, dirty, origin, error)``, ``files`` on disk, ``commits``, ``objects``
    of the history (with contents, or ``history_of`` where repositories share them), the ``identities`` of commits made now; ``consistency`` is the result of ``consistency.check``. A scan since a base has ``bases``, and its files, commits and
    objects are those since it (``files_since``, and readers of ``repos`` with a ``base``). ``consistency_bases`` are bases of the consistency check of a whole scan.
    Without a row of ``consistency`` that check is unknown, which blocks, unless the caller says that none is expected. ``checks`` has a status by name; ``report`` is the JSON of all. What couldn't be read is an issue, its status
    tool_error and its checks none: never a pass. Without ``files`` rows a repository lacks its documents; with ``expected`` and without
    ``identities`` the current identity is unknown.
    """
    scoped = bases is not None
    wide = repos.select("repo_id", "head", F.coalesce("dirty", F.lit(True)).alias("dirty"), "origin", F.col("error").alias("fault"), F.lit(marked).alias("marked"))
    wide = wide.join(_worktree(files, marked, marker), "repo_id", "left").join(_identities(commits, expected), "repo_id", "left")
    if objects is None:
        wide = wide.withColumns({"broken_history": F.lit(False), "old_secrets": F.lit(0), "old_homes": F.array().cast(_NAMES)})
    else:
        wide = wide.join(_history(objects), "repo_id", "left")
    if identities is None:
        wide = wide.withColumns({"now_author": F.lit(None).cast("string"), "now_committer": F.lit(None).cast("string")})
    else:
        wide = wide.join(identities.select("repo_id", F.col("author").alias("now_author"), F.col("committer").alias("now_committer")), "repo_id", "left")
    if consistency is None:
        wide = wide.withColumn("consistency", F.lit(None).cast("struct<status:string,mode:string,findings:array<string>>"))
    else:
        wide = wide.join(consistency.select("repo_id", F.struct("status", "mode", "findings").alias("consistency")), "repo_id", "left")
    scope = F.struct(F.lit("repository").alias("mode"))
    base_fault = F.lit(None).cast("string")
    if bases is not None:
        wide = wide.join(bases.select("repo_id", F.struct("oid", "ref", "valid").alias("base")), "repo_id", "left")
        base_fault = F.when(~F.coalesce("base.valid", F.lit(False)), "invalid_non_remote_or_non_ancestor_base_ref")
        scope = F.struct(F.lit("target_diff").alias("mode"), evidence_label(F.col("base.ref")).alias("resolved_base_ref"), F.col("base.oid").alias("base_oid"))
    own_scope = F.struct(F.lit("same_as_scan").alias("mode"))
    if consistency_bases is not None and bases is None:
        wide = wide.join(consistency_bases.select("repo_id", F.struct("oid", "ref", "valid").alias("own_base")), "repo_id", "left")
        base_fault = F.when(~F.coalesce("own_base.valid", F.lit(False)), "invalid_consistency_base_ref")
        own_scope = F.struct(F.lit("target_diff").alias("mode"), evidence_label(F.col("own_base.ref")).alias("resolved_base_ref"), F.col("own_base.oid").alias("base_oid"))
    if release:
        # the rules are columns of the README's own row, under the repository's id
        design = readme.release_review(wide.select(F.col("repo_id").alias("doc_id"), F.col("readme").alias("text")))
        wide = wide.join(design.select(F.col("doc_id").alias("repo_id"), F.struct("status", "release_gate", "codes", "recommended").alias("design")), "repo_id", "left")

    yes = lambda c: F.coalesce(c, F.lit(False))
    issue = F.coalesce(
        F.when(F.col("fault") == "NotARepository", "not_git_repository"),
        base_fault,
        F.when(F.col("fault").isNotNull() | yes("broken_log"), "git_probe_failed"),
        F.when(yes("broken_files"), "git_worktree_inventory_failed"),
        F.concat(F.lit("worktree_file_unreadable:"), evidence_label(F.col("unread_file"))),
        F.when(yes("broken_history"), "git_history_inventory_failed"),
    )
    parts = _checks(expected, scoped, release, consistency_expected)
    rows = wide.withColumn("issue", issue).withColumns({f"check_{k}": c for k, c in parts.items()})
    audited = [F.col(f"check_{k}.status") for k in parts if k in audited_checks(scoped, release)]
    some = lambda *values: F.exists(F.array(*audited), lambda s: s.isin(*values))
    status = F.when(F.col("issue").isNotNull() | some("tool_error"), "tool_error").when(some("fail", "unknown"), "blocked").otherwise("pass")
    intact = F.col("issue").isNull()
    rows = rows.withColumn("status", status).withColumn("issues", F.array_compact(F.array("issue")))
    checks = F.when(intact, F.create_map(*[x for k in parts for x in (F.lit(k), F.col(f"check_{k}.status"))])).alias("checks")
    named = F.when(intact, F.struct(*[F.col(f"check_{k}").alias(k) for k in parts]))
    report = F.to_json(
        F.struct(
            "status",
            F.when(~intact, F.col("issues")).alias("issues"),
            F.when(intact, F.lit(DECISION)).alias("publication_decision"),
            evidence_label(F.col("repo_id").cast("string")).alias("repo"),
            F.when(intact, F.col("head")).alias("head"),
            F.when(intact, scope).alias("scan_scope"),
            F.when(intact, own_scope).alias("consistency_scope"),
            named.alias("checks"),
        )
    )
    return rows.select("repo_id", "status", "issues", checks, exit_code(F.col("status")).alias("exit_code"), report.alias("report"))


def check_rows(scanned: DataFrame) -> DataFrame:
    """``repo_id, name, status, missing, invalid, policy`` of a scan's checks, as ``dialogue.conversation`` reads them."""
    parts = "checks struct<required_documents: struct<missing: array<string>, invalid: array<string>>, commit_identity: struct<policy: string>>"
    rows = scanned.select("repo_id", F.from_json("report", parts).alias("r"), F.explode("checks").alias("name", "status"))
    of = lambda name, c: F.when(F.col("name") == name, F.col(f"r.checks.{name}.{c}")).alias(c)
    return rows.select("repo_id", "name", "status", of("required_documents", "missing"), of("required_documents", "invalid"), of("commit_identity", "policy"))


def enriched(scanned: DataFrame, schema_id: str, audience: str | Column = "unspecified", intent: str | None = None, release: bool = False, expected: str | None = None, guarantees: Sequence[str] = (), non_guarantees: Sequence[str] = ()) -> DataFrame:
    """``scanned`` with what a report's reader has to know beside it: the schema, the options of the run and the boundaries, in the caller's words.

    The options' bases are those of the report's own scopes; a report of a scan that failed has none.
    """
    base = lambda scope: F.get_json_object("report", f"$.{scope}.resolved_base_ref")
    mode = F.when(base("scan_scope").isNotNull(), "target_diff").otherwise("release" if release else "standard")
    options = F.struct((F.lit(audience) if isinstance(audience, str) else audience).alias("audience"), mode.alias("mode"), F.lit(bool(expected)).alias("expected_identity_configured"), F.lit(intent).cast("string").alias("intent"), base("scan_scope").alias("base_ref"), base("consistency_scope").alias("consistency_base_ref"))
    words = lambda w: F.array(*map(F.lit, w)).cast("array<string>")
    more = F.to_json(F.struct(F.lit(schema_id).alias("schema"), options.alias("options"), words(guarantees).alias("guarantees"), words(non_guarantees).alias("non_guarantees")))
    return scanned.withColumn("report", F.concat(F.regexp_replace("report", r"\}\z", ","), F.substr(more, F.lit(2))))
